"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every historical version of a file is a row (path, text). A version's text is addressed by its
SHA-256, so equal texts are one blob wherever and whenever they occur. The ledger is a table with a
row for each (blob, rule version) scanned so far, with its findings. A run takes the distinct blobs,
drops by anti-join the pairs that the ledger has, scans the rest once, appends them to the ledger
and joins the ledger's findings back to all paths.

Offsets come from two native calls for each rule: ``split`` gives the text between matches and
``regexp_extract_all`` the matches, and the running sum of their lengths places each match. The sum
runs over blocks of ``BLOCK`` matches and then within each, so a text's cost is linear in its matches.

Findings are those of the rules asked for, in their present versions: what an older version of a rule
found stays in the ledger and is not reported.

Defined results: a null or empty text is the empty blob and has no findings; texts are read whole;
every rule matches leftmost without overlap within its kind and failing matches are dropped;
repeated rows and equal texts share one scan and give repeated results; an empty table leaves the
ledger as it is; columns other than path and text are not needed and ignored.

Scale: the only wide shuffle moves each distinct blob once (copies are combined before it); the
join back moves hashes and findings, never texts, and sends a blob with very many paths (the empty
one, say) to them by broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import column, fresh_path, let, lookup, materialize, path_exists


@dataclass(frozen=True)
class Rule:
    """A pattern; ``group`` of a match must have ``shortest`` characters. ``version`` changes with them.

    ``hints`` are lower-case strings of which every match has one; texts without any aren't split.
    """

    kind: str
    pattern: str
    group: int = 0
    shortest: int = 1
    version: int = 1
    hints: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, 1, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, 1, ("akia",)),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: What the method adds to the base kinds.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("private key-----",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]+", version=2, hints=("eyj",)),
    Rule("bearer", r"(?i:bearer) [A-Za-z0-9._~+/-]{20,}=*", hints=("bearer ",)),
    Rule("urlauth", r"[a-z][a-z0-9+.-]{1,12}://[^\s:/@]{1,64}:[^\s:/@]{1,128}@", hints=("://",)),
)
RULES = BASE_RULES + MORE_RULES

#: Matches whose offsets are summed in one go.
BLOCK = 256

FINDING = "array<struct<start: int, rank: int, end: int, kind: string>>"
LEDGER = f"blob string, rule string, findings {FINDING}"


def _matches(text: Column, rule: Rule, rank: int) -> Column:
    """Findings of one rule as an array of (start, rank, end, kind)."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.pattern, -1)
    parts = F.arrays_zip(
        F.transform(gaps, F.length).alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(part, F.length).alias("own")
    )
    advance = lambda at, m: at + m["gap"] + F.coalesce(m["size"], F.lit(0))

    def block(matches: Column, at: Column) -> Column:
        def step(acc: Column, m: Column) -> Column:
            a, b = acc["at"] + m["gap"], advance(acc["at"], m)
            span = F.struct(a.alias("start"), F.lit(rank).alias("rank"), b.alias("end"), F.lit(rule.kind).alias("kind"))
            keep = m["size"].isNotNull() & (m["own"] >= rule.shortest)
            return F.struct(b.alias("at"), F.when(keep, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

        return F.aggregate(matches, F.struct(at.alias("at"), F.array().cast(FINDING).alias("found")), step, lambda acc: acc["found"])

    def place(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), advance))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), block))

    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda k: F.slice(p, k * BLOCK + 1, BLOCK))
    shaped = let(let(parts, cut), place)
    seen = F.lit(False)
    if rule.hints:
        for hint in rule.hints:
            seen = seen | F.contains(F.col("__folded"), F.lit(hint))
    else:
        seen = text.rlike(rule.pattern)
    return F.when(seen, shaped).otherwise(F.array().cast(FINDING))


def _blob(text: str) -> Column:
    return F.sha2(F.coalesce(column(text), F.lit("")), 256)


def blobs(versions: DataFrame, text: str = "text") -> DataFrame:
    """Distinct (blob, text) of all versions."""
    return versions.select(_blob(text).alias("blob"), F.coalesce(column(text), F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def _ranks(rules: tuple[Rule, ...]) -> dict[str, int]:
    """The place of each rule's kind among equal starts: that of RULES, then that in ``rules``."""
    known = [r.kind for r in RULES]
    kinds = known + [r.kind for r in rules if r.kind not in known]
    return {r.key: kinds.index(r.kind) for r in rules}


def scan(unseen: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows for (blob, text, rules): only the pairs named in ``rules`` are scanned."""
    rank = _ranks(rules)
    due = F.col("__due")
    entries = F.array(*[
        F.struct(F.lit(r.key).alias("rule"), F.when(F.array_contains(due, r.key), _matches(F.col("text"), r, rank[r.key])).alias("findings"))
        for r in rules
    ])
    folded = unseen.withColumn("__folded", F.lower("text"))
    entry = F.explode(F.filter(entries, lambda e: e["findings"].isNotNull()))
    return folded.select("blob", entry.alias("e")).select("blob", "e.rule", "e.findings")


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text", path: str | None = None) -> DataFrame:
    """Scan what the ledger lacks, append it, and return the whole ledger.

    ``path`` is the folder of the ledger's Parquet files in shared storage; a run appends to it.
    Without it a fresh folder is made in the cluster's shared folder. ``ledger`` may hold rows from
    elsewhere; without it the folder's own rows, if any, are the ledger.
    """
    spark = versions.sparkSession
    target = path or fresh_path(spark, "ledger")
    stored = path is not None and path_exists(spark, path)
    known = ledger if ledger is not None else spark.read.schema(LEDGER).parquet(path) if stored else empty_ledger(spark)
    keys = F.array(*[F.lit(r.key) for r in rules])
    found = blobs(versions, text)
    if ledger is None and not stored:
        unseen = found.withColumn("__due", keys)
    else:
        scanned = known.groupBy("blob").agg(F.collect_set("rule").alias("__done"))
        unseen = found.join(scanned, "blob", "left").withColumn("__due", F.array_except(keys, F.coalesce("__done", F.array().cast("array<string>")))).where(F.size("__due") > 0)
    scan(unseen, rules).write.mode("append").parquet(target)
    stored_now = spark.read.schema(LEDGER).parquet(target)
    # Rows that both the given ledger and the folder hold are one.
    return known.unionByName(stored_now).dropDuplicates(["blob", "rule"]) if ledger is not None else stored_now


def findings(versions: DataFrame, ledger: DataFrame, path: str = "path", text: str = "text", out: str = "findings", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, findings) for every version row: what ``rules`` found, by start and rule order."""
    current = ledger.where(F.col("rule").isin([r.key for r in rules]) & (F.size("findings") > 0))
    by_blob = current.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("findings"))).alias("found"))
    rows = materialize(versions.select(column(path).alias("path"), _blob(text).alias("blob")), "versions")
    found = lookup(rows, by_blob, "blob")
    return found.select(F.col("path").alias(path), "blob", F.coalesce(F.col("found"), F.array().cast(FINDING)).alias(out))
