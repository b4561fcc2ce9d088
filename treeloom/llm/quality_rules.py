"""Quality rules judged per document and per host.

Every document is measured once, over its whole text, by a fixed list of rules.
Failures are counted by host (one narrow aggregate with map-side combine), each
host's failure rate is shrunk towards the corpus by an empirical beta prior, and
the verdict on the host is joined back to its documents.

*Rules on rates* (symbols a word, exclamation marks a word, capitals a letter,
repeated words a word) fail where the count exceeds what the limit allows by a
one-sided score test at 1 %: ``k / n > t`` and ``(k - n t)^2 > z^2 var``, with the
variance of a Poisson count (signs) or of a binomial one (capitals, repeats) at the
limit.  One sign in two words proves nothing, while for long texts the limit
itself decides; no length is exempt.  Limits and level are conventions, not fitted.

*The prior* of a rule is the beta distribution whose mean is the rate of all
documents and whose spread is that of the hosts' rates, less what sampling alone
gives them (moments of the beta-binomial, weighted by documents; Kleinman, 1973):
with ``N`` documents on ``k`` hosts and ``S = sum(n_i (p_i - m)^2)`` the correlation
within hosts is ``(S / (m (1 - m)) - (k - 1)) / (N - sum(n_i^2) / N - (k - 1))``, and
the prior weighs ``1 / correlation - 1`` documents.  A tail of one-document hosts,
which shows nothing of a spread, so shrinks to the common rate.

A *hard* failure rejects a document by itself.  A *soft* failure rejects it
when ``soft_limit`` rules fail together, or when its host is ``bad``; on a
``watch`` host two soft failures are enough.  A document that breaks no rule is
kept whatever its host, so clean pages survive a bad neighbourhood.

The host is the domain of a host column that holds addresses
(``scheme://user@Domain:port/path``, lower case, without ``www.``), and the column
itself otherwise.

Defined results: null or blank text fails the hard rule ``empty``; a null host
counts as the host ``''``; repeated rows are measured and returned each; rates
that tie with a threshold are on its worse side; an empty table gives an empty
table; other columns, whatever their names, pass through
:func:`filter_documents` untouched.  A single host, or hosts whose rates spread no
wider than chance, shrink fully to the common rate (weight ``ALWAYS``); hosts
whose documents all fail or all pass keep their own.

The text is read once: flags are stored (with the documents where those are to be
filtered) and what follows reads them.  No text is shuffled: a few counts per host
and task are, and the host table is broadcast while it has at most
``BROADCAST_HOSTS`` rows (counted) and joined by Spark's choice, with adaptive
splitting of hot hosts, beyond.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.llm.columns import named, own, unused
from treeloom.plans.staging import materialize

HARD = ("empty", "symbols", "exclaim", "shout", "stutter")
SOFT = ("lines", "short", "long_words", "few_letters")
RULES = HARD + SOFT
#: Weight of the prior, in documents, where hosts differ by chance only.
ALWAYS = 1_000_000.0
#: Square of the normal quantile of 1 %, one-sided.
Z2 = 5.41
#: Host tables up to so many rows are broadcast.
BROADCAST_HOSTS = 200_000
SYMBOLS = "#$%&*|<>{}~^\\_=+@"
SYMBOL_CLASS = "[" + "".join(f"\\{c}" for c in SYMBOLS) + "]+"
_ADDRESS = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:[wW][wW][wW]\.)?([^/?#:]+)"


def domain(host: Column) -> Column:
    """The domain of an address, and anything else as it is; ``''`` for null."""
    found = F.regexp_extract(host, _ADDRESS, 1)
    return F.coalesce(F.when(found != "", F.lower(found)).otherwise(host), F.lit(""))


def _repeats(words: Column) -> Column:
    """How many words equal the word before them.

    A fold names ``words`` once, so no rewrite of the plan can make it quadratic.
    """
    start = F.struct(F.lit("").alias("before"), F.lit(0).alias("n"))
    step = lambda acc, x: F.struct(x.alias("before"), (acc["n"] + (x == acc["before"]).cast("int")).alias("n"))
    return F.aggregate(words, start, step, lambda acc: acc["n"])


def _above(count: Column, n: Column, inverse: int, spread: int) -> Column:
    """Whether ``count / n`` is above ``1 / inverse`` by the score test; ``spread`` is ``inverse**2`` times the variance of one of ``n``."""
    excess = count.cast("double") * inverse - n
    return (excess > 0) & (excess * excess > n.cast("double") * (Z2 * spread))


def flagged(docs: DataFrame, text: str = "text", flags: str = "flags") -> DataFrame:
    """``docs`` with the column ``flags``: bit *k* says that the rule ``RULES[k]`` is broken."""
    body = F.coalesce(named(text), F.lit(""))
    lost = lambda pattern: F.length(body) - F.length(F.regexp_replace(body, pattern, ""))
    stems = ("words", "lines", "chars", "sym", "bang", "upper", "letters", "n", "again", "nl", "dl")
    at = dict(zip(stems, unused(docs, *[f"__{s}" for s in stems])))
    c = {stem: F.col(name) for stem, name in at.items()}
    first = docs.select(
        "*",
        F.array_remove(F.split(body, "[ \n\t\r\f]+"), "").alias(at["words"]),
        F.split(body, "\n").alias(at["lines"]),
        F.length(body).alias(at["chars"]),
        lost(SYMBOL_CLASS).alias(at["sym"]),
        (F.length(body) - F.length(F.replace(body, F.lit("!"), F.lit("")))).alias(at["bang"]),
        lost(r"\p{Lu}+").alias(at["upper"]),
        lost(r"\p{L}+").alias(at["letters"]),
    )
    counts = {"n": F.size(c["words"]), "again": _repeats(c["words"]), "nl": F.size(c["lines"]), "dl": F.size(F.array_distinct(c["lines"]))}
    second = first.select(*own(docs), *[c[s] for s in ("chars", "sym", "bang", "upper", "letters")], *[x.alias(at[s]) for s, x in counts.items()])
    n, letters = c["n"], c["letters"]
    broken = {
        "empty": n == 0,
        "symbols": _above(c["sym"], n, 5, 5),
        "exclaim": _above(c["bang"], n, 4, 4),
        "shout": _above(c["upper"], letters, 2, 1),
        "stutter": _above(c["again"], n, 5, 4),
        "lines": (c["nl"] >= 5) & (c["dl"] * 10 < c["nl"] * 7),
        "short": (n > 0) & (n < 3),
        "long_words": (n >= 20) & (c["chars"] > n * 16),
        "few_letters": (n >= 5) & (letters * 2 < c["chars"]),
    }
    bits = reduce(lambda a, b: a + b, [F.when(broken[r], 1 << k).otherwise(0) for k, r in enumerate(RULES)])
    return second.select(*own(docs), bits.alias(flags))


def broke(flags: Column, rule: str) -> Column:
    return flags.bitwiseAND(1 << RULES.index(rule)) > 0


def host_rates(flags: DataFrame, bad: float = 0.4, watch: float = 0.25) -> DataFrame:
    """One row for each host of ``(host, flags)``: counts, shrunk failure rates of every rule, verdict.

    ``host_verdict`` rests on the rate of documents that break any rule.
    """
    kinds = [*RULES, "any"]
    counts = flags.groupBy("host").agg(
        F.count(F.lit(1)).alias("docs"),
        *[F.sum(broke(F.col("flags"), r).cast("long")).alias(f"n_{r}") for r in RULES],
        F.sum((F.col("flags") > 0).cast("long")).alias("n_any"),
    )
    docs = F.col("docs").cast("double")
    failed = lambda k: F.col(f"n_{k}").cast("double")
    moments = counts.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum("docs").alias("all_docs"),
        F.sum(docs * docs).alias("squares"),
        *[F.sum(f"n_{k}").alias(f"f_{k}") for k in kinds],
        *[F.sum(failed(k) * failed(k) / docs).alias(f"t_{k}") for k in kinds],
    )
    joined = counts.crossJoin(F.broadcast(moments))  # one row
    out = joined.select("host", "docs", *[f"n_{k}" for k in kinds], *[_shrunk(k).alias(f"rate_{k}") for k in kinds])
    return out.withColumn(
        "host_verdict",
        F.when(F.col("rate_any") >= bad, "bad").when(F.col("rate_any") >= watch, "watch").otherwise("good"),
    )


def _shrunk(kind: str) -> Column:
    n, k, f = F.col("all_docs").cast("double"), F.col("hosts") - 1, F.col(f"f_{kind}").cast("double")
    m = f / n
    within = m * (1 - m)
    room = n - F.col("squares") / n - k
    correlation = F.when((within > 0) & (room > 1e-9), ((F.col(f"t_{kind}") - f * m) / within - k) / room).otherwise(0.0)
    strength = F.when(correlation <= 1 / ALWAYS, F.lit(ALWAYS)).when(correlation >= 1, F.lit(0.0)).otherwise(1 / correlation - 1)
    return F.round((F.col(f"n_{kind}") + m * strength) / (F.col("docs") + strength), 6)


def _judged(stored: DataFrame, host: str, flags: str, bad: float, watch: float, soft_limit: int) -> tuple[DataFrame, dict[str, Column]]:
    """``stored`` joined with its hosts' standing, and the columns that say so."""
    narrow = stored.select(domain(named(host)).alias("host"), F.col(flags).alias("flags"))
    at = unused(stored, "__host", "__rate", "__verdict")
    hosts = host_rates(narrow, bad, watch).select(*[F.col(c).alias(a) for c, a in zip(("host", "rate_any", "host_verdict"), at)])
    hosts = materialize(hosts, "hosts")
    if hosts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    soft_bits = sum(1 << RULES.index(r) for r in SOFT)
    hard_bits = (1 << len(RULES)) - 1 - soft_bits
    mask, verdict = F.col(flags), F.col(at[2])
    allowed = F.when(verdict == "bad", 0).when(verdict == "watch", 1).otherwise(soft_limit - 1)
    keep = (mask.bitwiseAND(hard_bits) == 0) & (F.bit_count(mask.bitwiseAND(soft_bits)) <= allowed)
    joined = stored.join(hosts, domain(named(host)) == F.col(at[0]))
    failed = F.concat_ws(",", *[F.when(broke(mask, r), F.lit(r)) for r in RULES])
    return joined, {"host": F.col(at[0]), "failed": failed, "host_rate": F.col(at[1]), "host_verdict": verdict, "keep": keep}


def verdicts(docs: DataFrame, text: str = "text", host: str = "source", bad: float = 0.4, watch: float = 0.25, soft_limit: int = 3) -> DataFrame:
    """One row for each document: what it broke, its host's standing, whether it stays."""
    flags = flagged(docs.select("doc_id", named(text).alias("text"), named(host).alias("host"))).drop("text")
    joined, said = _judged(materialize(flags, "flags"), "host", "flags", bad, watch, soft_limit)
    return joined.select("doc_id", *[c.alias(name) for name, c in said.items()])


def filter_documents(docs: DataFrame, text: str = "text", host: str = "source", bad: float = 0.4, watch: float = 0.25, soft_limit: int = 3) -> DataFrame:
    """The documents that stay, with the columns they came with."""
    (flags,) = unused(docs, "__flags")
    joined, said = _judged(materialize(flagged(docs, text, flags), "flagged"), host, flags, bad, watch, soft_limit)
    return joined.filter(said["keep"]).select(*own(docs))


def op2_host_quality(spark, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _above_sql(count: str, n: str, inverse: int, spread: int) -> str:
    return f"{count} * {inverse} > {n} and power({count}::double * {inverse} - {n}, 2) > {n}::double * {Z2 * spread!r}::double"


_CONDITIONS_SQL = {
    "empty": "n = 0",
    "symbols": _above_sql("sym", "n", 5, 5),
    "exclaim": _above_sql("bang", "n", 4, 4),
    "shout": _above_sql("up", "letters", 2, 1),
    "stutter": _above_sql("again", "n", 5, 4),
    "lines": "nl >= 5 and dl * 10 < nl * 7",
    "short": "n > 0 and n < 3",
    "long_words": "n >= 20 and chars > n * 16",
    "few_letters": "n >= 5 and letters * 2 < chars",
}


def verdicts_sql(table: str = "documents", bad: float = 0.4, watch: float = 0.25, soft_limit: int = 3, tail: str = "") -> str:
    """The same in DuckDB; ``tail`` replaces the last SELECT (over ``judged``)."""
    kinds = [*RULES, "any"]
    shrunk = lambda k: f"round((n_{k} + m_{k} * s_{k}) / (docs + s_{k}), 6)"
    within = lambda k: f"((f_{k}::double / n) * (1 - f_{k}::double / n))"
    correlation = lambda k: (
        f"case when f_{k} > 0 and f_{k} < n and n - squares / n - k > 1e-9"
        f" then ((t_{k} - f_{k}::double * (f_{k}::double / n)) / {within(k)} - k) / (n - squares / n - k) else 0.0 end as c_{k}, f_{k}::double / n as m_{k}"
    )
    strength = lambda k: f"case when c_{k} <= {1 / ALWAYS!r} then {ALWAYS} when c_{k} >= 1 then 0.0 else 1 / c_{k} - 1 end as s_{k}"
    return f"""
with base as (select *, coalesce(text, '') as body from {table}),
words as (
  select *, list_filter(string_split(translate(body, chr(10) || chr(9) || chr(13) || chr(12), '    '), ' '), lambda x: x <> '') as w,
         string_split(body, chr(10)) as ls
  from base),
measured as (
  select *, len(w) as n,
         len(list_filter(w, lambda x, i: i > 1 and x = w[i - 1])) as again,
         len(ls) as nl, len(list_distinct(ls)) as dl, length(body) as chars,
         length(body) - length(translate(body, '{SYMBOLS}', '')) as sym,
         length(body) - length(translate(body, '!', '')) as bang,
         length(body) - length(regexp_replace(body, '\\p{{Lu}}+', '', 'g')) as up,
         length(body) - length(regexp_replace(body, '\\p{{L}}+', '', 'g')) as letters
  from words),
flags as (
  select *, {", ".join(f"({c}) as f_{r}" for r, c in _CONDITIONS_SQL.items())},
         coalesce(case when regexp_extract(source, '{_ADDRESS}', 1) <> '' then lower(regexp_extract(source, '{_ADDRESS}', 1)) else source end, '') as host
  from measured),
counts as (
  select host, count(*) as docs, {", ".join(f"sum(f_{r}::int)::bigint as n_{r}" for r in RULES)},
         sum(({" or ".join(f"f_{r}" for r in RULES)})::int)::bigint as n_any
  from flags group by host),
moments as (
  select count(*) - 1 as k, sum(docs)::double as n, sum(docs::double * docs) as squares,
         {", ".join(f"sum(n_{k})::double as f_{k}, sum(n_{k}::double * n_{k} / docs) as t_{k}" for k in kinds)}
  from counts),
correlations as (select {", ".join(correlation(k) for k in kinds)} from moments),
strengths as (select *, {", ".join(strength(k) for k in kinds)} from correlations),
hosts as (
  select host, {shrunk("any")} as host_rate,
         case when {shrunk("any")} >= {bad} then 'bad' when {shrunk("any")} >= {watch} then 'watch' else 'good' end as host_verdict
  from counts, strengths),
judged as (
  select flags.*, host_rate, host_verdict,
         concat_ws(',', {", ".join(f"case when f_{r} then '{r}' end" for r in RULES)}) as failed,
         not ({" or ".join(f"f_{r}" for r in HARD)}) and
         {" + ".join(f"f_{r}::int" for r in SOFT)} <= case host_verdict when 'bad' then 0 when 'watch' then 1 else {soft_limit - 1} end as keep
  from flags join hosts using (host))
{tail or "select doc_id, host, failed, host_rate, host_verdict, keep from judged"}"""
