"""Source trees: git mirrors, snapshots of a commit, and files as rows."""

from __future__ import annotations

import subprocess
import tarfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import naming

GIT_SECONDS = 120
HOST = "https://github.com"


class Mirrors:
    """Bare clones in a folder of the driver; the network is used when one is missing."""

    def __init__(self, folder: str | Path = ".mirrors") -> None:
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def path(self, repo: str) -> Path:
        return self.folder / repo.replace("/", "__")

    def url(self, repo: str) -> str:
        return f"{HOST}/{repo}.git"

    def _git(self, *args: str) -> None:
        subprocess.run(["git", *args], check=True, timeout=GIT_SECONDS, capture_output=True)

    def ensure(self, repo: str) -> Path:
        """The mirror's folder, cloned once."""
        if not self.path(repo).exists():
            self._git("clone", "--bare", self.url(repo), str(self.path(repo)))
        return self.path(repo)

    def extract(self, repo: str, commit: str, target: str | Path) -> Path:
        """The tree of ``commit`` under ``target``; fetches once if the mirror lacks it."""
        mirror, target = self.ensure(repo), Path(target)
        target.mkdir(parents=True, exist_ok=True)
        archive = target / ".snapshot.tar"
        pack = ("--git-dir", str(mirror), "archive", "--format=tar", "--output", str(archive), commit)
        try:
            self._git(*pack)
        except subprocess.CalledProcessError:
            self._git("--git-dir", str(mirror), "fetch", "origin")
            try:
                self._git(*pack)
            except subprocess.CalledProcessError as error:
                raise ValueError(f"{repo} has no commit {commit}, nor has its origin") from error
        with tarfile.open(archive) as tar:
            tar.extractall(target, filter="data")  # refuses paths that leave the folder
        archive.unlink()
        return target


def read_tree(spark: SparkSession, folder: str | Path, repo: str, commit: str) -> DataFrame:
    """``(repo, commit, path, content)`` of all Python sources below a folder that executors can read.

    Content stays bytes; the parser decodes it, replacing what is not UTF-8.
    """
    root = str(folder) if "://" in str(folder) else Path(folder).resolve().as_uri()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(root)
    inside = root.split("://", 1)[-1].rstrip("/") + "/"
    whole = F.regexp_replace("path", r"^[a-z0-9]+:(//)?", "")
    files = raw.select(F.lit(repo).alias("repo"), F.lit(commit).alias("commit"), F.substring(whole, len(inside) + 1, 1_000_000).alias("path"), "content")
    return files.filter(naming.is_source_path(F.col("path")))


def read_patch(spark: SparkSession, path: str) -> DataFrame:
    """One row with the whole text of a diff."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("patch"))
