"""Asks for a repository, a commit and a diff; writes the context as JSON."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

from treeloom.build import Builder, extract_and_validate
from treeloom.sources import store, trees


def main(ask=input) -> str:
    spark = SparkSession.builder.appName("treeloom").getOrCreate()
    repo, commit = ask("Repository (owner/name): ").strip(), ask("Commit: ").strip()
    patch = trees.read_patch(spark, ask("Diff file: ").strip()).first()["patch"]
    code_file, test_file = ask("Code file: ").strip(), ask("Test file: ").strip()
    instance = {"repo": repo, "base_commit": commit, "patch": patch, "code_file": code_file, "test_file": test_file}
    contexts, _ = extract_and_validate(Builder(spark), instance)
    target = Path("contexts") / f"{repo.replace('/', '_')}_{commit[:8]}_context.json"
    store.save_context(contexts, "1", str(target))
    print(contexts.summary("1"))
    print(f"written to {target}")
    return str(target)


if __name__ == "__main__":
    main()
