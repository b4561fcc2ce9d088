"""Secret candidates of a corpus, judged by how widely each is owned.

Every text is scanned whole for credential patterns.  A candidate's value is
hashed, and the hashes are aggregated over the corpus by distinct repositories
and owners: a value that many owners carry is a copied example, one that a
single owner carries and that looks random is a live-looking leak.

Verdicts, first that applies: ``placeholder`` (an example word, or too few
different characters), ``widely_copied`` (``copied_owners`` owners or more),
``live_looking`` (one owner, at least ``min_length`` characters and
``min_entropy`` bits a character), ``shared`` (more owners, fewer than
``copied_owners``) and ``weak`` (the rest).

A value is hashed and measured where it is found; hashes, lengths and entropies
are what is shuffled and stored, never the value.  Only candidates go on, about
as many rows as there are secrets; the text is read once.  A value copied into a million documents is one
key: counting combines on the map side, and the join back is split by adaptive
execution when it is skewed.

Defined results: null and empty texts have no candidates; a null owner counts as
the owner ``''`` and a null language as ``''``; a value that occurs several times
in a document is one row with its number of occurrences; rows that repeat an id
add up; ties of the kind go to the first in precedence; a text is scanned whole,
whatever its length; an empty table gives an empty table; other columns are not
looked at.  Values are reported as SHA-256 only.

The value of a private key is the whole of its body, from the BEGIN to the END
line, without headers, white space and escaped line ends, so a key has one hash
however it is wrapped; blocks of fewer than 16 characters are no candidates.  A
key without its END line is its lines of base64 as far as they go.

A value is one secret whatever stood before it: an assigned token is what its
pattern finds where it stands alone, spread is counted by the value, and its
kind is the first in precedence that any of its occurrences has.

A name is that of a secret if it has one of the key words in any place
(``aws_secret_access_key``, ``DB_PASSWORD``, ``clientSecret``).

``scan_sql`` says the same in DuckDB, whose patterns have no look-around: it takes
the first line of a key and knows the bare key words only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.plans.staging import materialize

_ASSIGN = r"\b(?i:api_?key|access_?key|secret|token|passwd|password|pwd)\b[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?"
# Private keys; white space and line ends may be escaped, as in JSON.  Possessive repeats, so that long texts need no stack.
_BEGIN = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
_END = r"-----END [A-Z ]{0,20}PRIVATE KEY-----"
_GAP = r"(?:\s|\\++[nrt])"
_HEADERS = rf"(?:[A-Za-z][A-Za-z0-9-]*+:[^\n\\]*+{_GAP}*+)*+"
_PEM_HEAD = rf"{_BEGIN}{_GAP}++{_HEADERS}"
_PEM_WHOLE = rf"(?:[A-Za-z0-9+/=]|{_GAP})*+{_END}"
_PEM_CUT = rf"[A-Za-z0-9+/=]{{16,}}+(?:{_GAP}++[A-Za-z0-9+/=]{{16,}}+(?=[ \t]*+(?:[\r\n\\\"']|\z)))*+"
PRIVATE_KEY = rf"{_PEM_HEAD}(?:{_PEM_WHOLE}|{_PEM_CUT})"
PRIVATE_KEY_REST = rf"^{_PEM_HEAD}|{_END}$|{_GAP}++"
KEY_LENGTH = 16

#: Kinds with their patterns, in order of precedence, as the SQL has them; all are in the syntax that Java and RE2 share.
KINDS = (
    ("aws_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    ("slack_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("google_key", r"\bAIza[0-9A-Za-z_-]{35}"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}"),
    ("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----\s+[A-Za-z0-9+/=]{16,}"),
    ("assignment", _ASSIGN + r"[A-Za-z0-9_./+=~-]{8,}"),
)
ANY = "|".join(f"(?:{p})" for _, p in KINDS)
#: What precedes the value in a match, in the SQL.
LEAD = f"^(?:{_ASSIGN}|-----BEGIN [A-Z ]{{0,20}}PRIVATE KEY-----\\s+)"
#: Patterns that a value shows by itself.
TOKENS = tuple((name, pattern) for name, pattern in KINDS if name not in ("private_key", "assignment"))
_TOKEN = "(?:" + "|".join(f"(?:{p})" for _, p in TOKENS) + ")"
# A name with a key word in it, taken whole; it starts where a run of its characters or the last match ends, so that a long run is read once.
_NAME = r"(?>[A-Za-z0-9_-]*?(?i:api_?key|access_?key|secret|token|passwd|password|pwd)[A-Za-z0-9_-]*+)"
_GIVEN = _NAME + r"[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?"
# Tokens and keys in name or value are candidates themselves, not parts of an assignment.
_ASSIGNMENT = rf"(?:(?<![A-Za-z0-9_-])|\G)(?={_GIVEN})(?![A-Za-z0-9_-]*?{_TOKEN}){_GIVEN}(?![A-Za-z0-9_./+=~-]*?(?:{_BEGIN}|{_TOKEN}))[A-Za-z0-9_./+=~-]{{8,}}"
#: The patterns of the query.
FOUND = tuple((name, {"private_key": PRIVATE_KEY, "assignment": _ASSIGNMENT}.get(name, pattern)) for name, pattern in KINDS)
FOUND_ANY = "|".join(f"(?:{p})" for _, p in FOUND)
NAMES = [name for name, _ in FOUND]
PLACEHOLDER = r"(?i)(example|sample|dummy|changeme|placeholder|your[_-]|xxxx|redacted|123456789|abcdefgh)"
#: Four equal letters occur by chance in a body of thousands.
KEY_PLACEHOLDER = PLACEHOLDER.replace("xxxx", "x{8}")


def _value(match: Column) -> Column:
    key = F.regexp_replace(match, PRIVATE_KEY_REST, "")
    return F.when(match.rlike(f"^{_BEGIN}"), key).otherwise(F.regexp_replace(match, f"^{_GIVEN}", ""))


def _rank(match: Column, value: Column) -> Column:
    """The place of the kind in ``NAMES``."""
    out = F.when(match.rlike(f"^{_BEGIN}"), NAMES.index("private_key")).otherwise(NAMES.index("assignment"))
    for name, pattern in reversed(TOKENS):
        out = F.when(value.rlike(f"^(?:{pattern})"), NAMES.index(name)).otherwise(out)
    return out


def _entropy(value: Column) -> Column:
    """Shannon entropy in bits a character, rounded to three places; characters are summed in order."""
    letters = F.array_sort(F.array_distinct(F.split(value, "")))
    n = F.length(value)
    share = lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n
    return F.round(F.aggregate(letters, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c))), 3)


def candidates(docs: DataFrame) -> DataFrame:
    """``(doc_id, owner, repository, secret_hash, length, entropy, example, rank, occurrences)``.

    The value itself goes no further than this: it is hashed and measured where it
    is found, before anything is shuffled or stored.  ``rank`` is the place of the
    kind in ``NAMES``; ``example`` has bit 1 for what looks like a placeholder as a
    token and bit 2 as a private key.
    """
    found = docs.select(
        "doc_id",
        F.coalesce(F.col("source"), F.lit("")).alias("owner"),
        F.coalesce(F.col("lang"), F.lit("")).alias("lang"),
        F.explode(F.regexp_extract_all("text", F.lit(FOUND_ANY), F.lit(0))).alias("match"),
    )
    valued = found.select("doc_id", "owner", F.concat("owner", F.lit("/"), "lang").alias("repository"), "match", _value(F.col("match")).alias("value"))
    ranked = valued.select("doc_id", "owner", "repository", "value", _rank(F.col("match"), F.col("value")).alias("rank"))
    kept = ranked.filter((F.col("rank") != NAMES.index("private_key")) | (F.length("value") >= KEY_LENGTH))
    value = F.col("value")
    few = F.size(F.array_distinct(F.split(value, ""))) < 6
    flag = lambda pattern, bit: F.when(few | value.rlike(pattern), bit).otherwise(0)
    measured = kept.select(
        "doc_id", "owner", "repository", "rank",
        F.sha2("value", 256).alias("secret_hash"),
        F.length(value).alias("length"),
        _entropy(value).alias("entropy"),
        (flag(PLACEHOLDER, 1) + flag(KEY_PLACEHOLDER, 2)).alias("example"),
    )
    same = ["length", "entropy", "example"]
    return measured.groupBy("doc_id", "owner", "repository", "secret_hash").agg(
        *[F.min(c).alias(c) for c in same], F.min("rank").alias("rank"), F.count(F.lit(1)).alias("occurrences")
    )


def ownership(stored: DataFrame, copied_owners: int, min_length: int, min_entropy: float) -> DataFrame:
    """One row for each hash: its kind, its spread over documents, repositories and owners, and the verdict."""
    by_hash = stored.groupBy("secret_hash").agg(
        *[F.min(c).alias(c) for c in ("rank", "length", "entropy", "example")],
        F.countDistinct("doc_id").alias("n_docs"),
        F.countDistinct("repository").alias("n_repositories"),
        F.countDistinct("owner").alias("n_owners"),
    )
    kind = F.element_at(F.array(*map(F.lit, NAMES)), F.col("rank") + 1)
    bit = F.when(F.col("rank") == NAMES.index("private_key"), 2).otherwise(1)
    verdict = (
        F.when(F.col("example").bitwiseAND(bit) > 0, "placeholder")
        .when(F.col("n_owners") >= copied_owners, "widely_copied")
        .when(F.col("n_owners") > 1, "shared")
        .when((F.col("length") >= min_length) & (F.col("entropy") >= min_entropy), "live_looking")
        .otherwise("weak")
    )
    return by_hash.select("secret_hash", kind.alias("kind"), "n_docs", "n_repositories", "n_owners", "entropy", verdict.alias("verdict"))


def scan(docs: DataFrame, copied_owners: int = 3, min_length: int = 16, min_entropy: float = 3.0) -> DataFrame:
    """One row for each document and secret in it, with the secret's standing in the corpus."""
    stored = materialize(candidates(docs), "candidates")
    standing = ownership(stored, copied_owners, min_length, min_entropy)
    return stored.select("doc_id", "owner", "repository", "secret_hash", "occurrences").join(standing, "secret_hash").select(
        "doc_id", "owner", "repository", "kind", "secret_hash", "occurrences", "n_docs", "n_repositories", "n_owners", "entropy", "verdict"
    )


def op1_secret_ownership(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def scan_sql(table: str = "documents", copied_owners: int = 3, min_length: int = 16, min_entropy: float = 3.0) -> str:
    kind = " ".join(f"when regexp_matches(value, {_quoted(f'^(?:{p})')}) then {NAMES.index(n)}" for n, p in TOKENS)
    share = "((length(value) - length(replace(value, c, ''))) / length(value))"
    return f"""
with found as (
  select doc_id, coalesce(source, '') as owner, coalesce(source, '') || '/' || coalesce(lang, '') as repository,
         unnest(regexp_extract_all(text, {_quoted(ANY)}, 0)) as m
  from {table}),
valued as (
  select *, regexp_replace(m, {_quoted(LEAD)}, '') as value from found),
stored as (
  select doc_id, owner, repository, value, count(*) as occurrences,
         min(case {kind} when starts_with(m, '-----BEGIN') then {NAMES.index("private_key")} else {NAMES.index("assignment")} end) as rank
  from valued group by all),
by_value as (
  select value, [{", ".join(f"'{n}'" for n in NAMES)}][min(rank) + 1] as kind,
         count(distinct doc_id) as n_docs, count(distinct repository) as n_repositories, count(distinct owner) as n_owners,
         round(list_sum(list_transform(list_sort(list_distinct(string_split(value, ''))), lambda c: -{share} * log2({share}))), 3) as entropy
  from stored group by value),
standing as (
  select *, case
    when regexp_matches(value, {_quoted(PLACEHOLDER)}) or len(list_distinct(string_split(value, ''))) < 6 then 'placeholder'
    when n_owners >= {copied_owners} then 'widely_copied'
    when n_owners > 1 then 'shared'
    when length(value) >= {min_length} and entropy >= {min_entropy} then 'live_looking'
    else 'weak' end as verdict
  from by_value)
select doc_id, owner, repository, kind, sha256(value) as secret_hash, occurrences, n_docs, n_repositories, n_owners, entropy, verdict
from stored join standing using (value)"""
