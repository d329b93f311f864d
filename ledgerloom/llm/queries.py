"""Queries of the text problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import leak, mixing, moderation, pii, reading
from ledgerloom.sources.shared import fresh


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _moderated(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    model = moderation.fit(table(spark, sf_dir, "moderation_sample"))
    return moderation.scores(table(spark, sf_dir, "chat_message"), model, id_col="id", msg="msg", keep=keep)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = moderation.fit(table(spark, sf_dir, "moderation_sample"))
    return moderation.found(table(spark, sf_dir, "chat_message"), model, id_col="id", msg="msg")


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moderated(spark, sf_dir).select("id", *moderation.KINDS)


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moderation.rates(_moderated(spark, sf_dir, ("source",)), "source")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.findings(table(spark, sf_dir, "chat_message"), "id", ("msg",), ("username",))
    return found.select("id", "field", "kind").distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable messages with placeholders."""
    chat = table(spark, sf_dir, "chat_message").select("id", "ts", "source", "username", "msg").where("id IS NOT NULL").distinct()
    return chat.select("id", "ts", "source", pii.redacted(F.col("username"), handle=True).alias("username"), pii.redacted(F.col("msg")).alias("msg"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"), doc_id="doc_id", text="text", item_id="item_id", passage="passage")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where("kind = 'verbatim'").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbatim and re-parameterised leaks with the number of windows."""
    return _leaks(spark, sf_dir)


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sized(table(spark, sf_dir, "documents"), "doc_id", "source", "text")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[mixing.SourcePlan]]:
    """Sizes, counted once and written, and the plan."""
    sizes = _sizes(spark, sf_dir)
    sizes.write.parquet(path := fresh(spark, "sizes"))
    sizes = spark.read.schema(sizes.schema).parquet(path)
    return sizes, mixing.plan(sizes, mixing.read_targets(table(spark, sf_dir, "mix_target")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that the solver pins."""
    plans = mixing.plan(_sizes(spark, sf_dir), mixing.read_targets(table(spark, sf_dir, "mix_target")))
    return mixing.plan_frame(spark, plans).where("NOT reachable").select("source")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.realise(*_mix(spark, sf_dir))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, plans = _mix(spark, sf_dir)
    return mixing.shares(mixing.realise(sizes, plans), plans)


def _levels(spark: SparkSession, sf_dir: str, documents: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    model = reading.fit(table(spark, sf_dir, "reading_sample"))
    return reading.levels(documents, model, doc_id="doc_id", text="text", keep=keep)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demanding documents of lang ``en`` only."""
    english = table(spark, sf_dir, "documents").where("lang = 'en'")
    return _levels(spark, sf_dir, english, ("source",)).where("band = 'demanding'").select("doc_id")


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level of every document, whatever its lang; the scale is an English one."""
    return _levels(spark, sf_dir, table(spark, sf_dir, "documents"), ("source", "lang"))


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every lang, mean grade and bands per source."""
    g = p9_levels(spark, sf_dir).groupBy("source")
    return g.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("grade").alias("mean_grade"), *[F.count_if(F.col("band") == b).alias(f"n_{b}") for b in reading.BANDS])


def p9_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out passages graded right, per group of kin passages and band."""
    return reading.validation(spark, reading.fit(table(spark, sf_dir, "reading_sample")))


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_scores, p2_rates, p4_found, p4_redacted, p7_found, p7_leaks, p8_found, p8_mixture, p8_shares, p9_found, p9_levels, p9_profile, p9_validation)
}

_UNBRACKETED = r"regexp_replace(TEXT, '\([^()]*\)|\[[^\[\]]*\]', ' ', 'g')"
_WORDS = r"regexp_extract_all(lower(replace(regexp_replace(TEXT, '(\pL)[-‐\x{00AD}][ \t]*(\r\n|\r|\n)\s*(\pL)', '\1\3', 'g'), chr(173), '')), '[\pL\pN]+')"


def _windows_sql(id_col: str, text: str, tab: str) -> str:
    bare = text
    for _ in range(4):  # nested brackets
        bare = _UNBRACKETED.replace("TEXT", bare)
    ws = f"SELECT DISTINCT {id_col}, {_WORDS.replace('TEXT', bare)} AS ws FROM {tab} WHERE {id_col} IS NOT NULL"
    return f"SELECT DISTINCT {id_col}, array_to_string(ws[p:p + 11], ' ') AS w FROM (SELECT {id_col}, ws, unnest(range(1, len(ws) - 10)) AS p FROM ({ws}) a) b"


#: Trained models, tokenizers and transducers have no SQL; brute force and held-out data test them.
ORACLE_SQL: dict[str, str] = {
    "p7_found": f"SELECT DISTINCT doc_id, item_id FROM ({_windows_sql('doc_id', 'text', 'documents')}) d JOIN ({_windows_sql('item_id', 'passage', 'eval_item')}) i USING (w)",
}
