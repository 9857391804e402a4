"""The queries of the operators: each applies its operator to the whole table and derives digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, chat, decontaminate, jaccard, language_model, licenses, media, mixing, periodic, pii, quality, secrets, substrings
from tidemark.llm.common import let, materialize, read_table

CONFLICT = "</s>[INST] ok [/INST]"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = chat.INST
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", CONFLICT), (-7, 1, "assistant", CONFLICT)], "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(turns.unionByName(hard), t)
    read = chats.withColumns({"turns": t.parse(F.col("formatted")), "loss_text": F.array_join(chat.loss_texts(chats, t), "")})
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "license_digest", "license", F.array_join("notices", ",").alias("notices"), F.size("notices").cast("long").alias("n_notices"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", F.col("quality.keep").alias("keep"), F.col("quality.score").alias("score"), F.col("quality.posterior").alias("posterior"), F.array_join("quality.votes", ",").alias("votes"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_media(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    read = media.read_media(stored.select("doc_id", "media.*"))
    sample = F.col("samples.payload")
    return read.select(
        "doc_id", "n_bytes", F.col("samples.payload_bytes").alias("payload_bytes"), F.sha2(sample, 256).alias("payload_sha256"), F.crc32(F.substring(sample, -32, 32)).alias("tail_crc32"),
        F.length("png").cast("long").alias("media_bytes"), F.sha2("png", 256).alias("media_sha256"), F.lower(F.hex("samples.hash")).alias("feature"),
    )


def _span_text(spans: Column, kind: str = "kind") -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s[kind], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _counts(spans: Column, kinds) -> list[Column]:
    """Columns n_<kind>: how many of the spans are of each kind."""
    of = lambda kind: F.filter(spans, lambda s: s["kind"] == kind)
    return [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in kinds]


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    base = F.col("__pii.base")
    counts = _counts(base, pii.BASE_KINDS)
    return found.select("doc_id", *counts, F.sha2(_span_text(base), 256).alias("base_sha256"), _span_text(F.col("spans")).alias("spans"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return found.select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), (c["n_hit"] > 0).alias("contaminated"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")) % 7
    docs = docs.withColumn("held_out", fold == 2)
    model = language_model.train(docs.where("NOT held_out"))
    scored = language_model.score_texts(docs, model).drop("text", "perplexity")
    # The scores are stored, which frees the model's arrays.
    scores = materialize(scored, "scores")
    language_model.delete(spark, model)
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = jaccard.group_similar(read_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.findings(versions, secrets.update_ledger(versions), "doc_id")
    names = [r.kind for r in secrets.BASE_RULES]
    base = F.filter("findings", lambda s: s["kind"].isin(names))
    counts = _counts(base, names)
    return found.select("doc_id", *counts, F.sha2(_span_text(base), 256).alias("base_sha256"), _span_text(F.col("findings")).alias("spans"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    r = F.col("repeats")
    return cut.select("doc_id", r["n_words"].alias("n_words"), r["n_removed"].alias("n_removed"), F.sha2(r["kept"], 256).alias("kept_sha256"))


def _with_tails(docs: DataFrame) -> DataFrame:
    """The documents of op12: words of a tenth of them repeat a period from some word on."""
    h = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8"))
    g = F.floor(h / 10).cast("long")

    def tail(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.withColumn("text", F.when(h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, tail(w)).otherwise(""))).otherwise(F.col("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_periodic(_with_tails(read_table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text")
    r, best = F.col("periodic.runs"), F.col("periodic.strongest")
    lines = F.array_join(F.transform(r, lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size(r).cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * periodic.strongest.length DIV periodic.strongest.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("periodic.collapsed", 256).alias("collapsed_sha256"),
    )


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(read_table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    return found.select("doc_id", *[F.col(f"alignment.{n}").alias(n) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], F.col("alignment.groups").alias("groups_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_license_scan, op3_quality_classifier, op4_media_columns, op5_pii, op6_decontamination, op7_mixing, op8_language_model, op9_jaccard_join, op10_secret_scan,
        op11_substring_dedup, op12_periodic_runs, op13_token_alignment,
    )
}
