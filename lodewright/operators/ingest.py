"""Expansion of nested source rows, text extraction, and the document constructor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodewright.config import CONTEST_SOURCE, DEFAULT, DOCUMENT, MATH_SOURCE, Thresholds
from lodewright.functions.hashing import normalized_hash, raw_hash
from lodewright.functions.text import filled, is_binary, is_python3_tag
from lodewright.operators.base import checkpoint

_EXERCISES = ("jina_textbook", "tiny_python", "spp_30k_verified")


def _has(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _string(df: DataFrame, name: str) -> Column:
    return F.coalesce(_has(df, name).cast("string"), F.lit(""))


def _contest_text(title: Column, pid: Column, description: Column, code: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n# "), pid, F.lit("\n\n"), description, F.lit("\n\n# solution\n"), code, F.lit("\n"))


def expand_contest(df: DataFrame, cap: int = 8) -> DataFrame:
    """First ``cap`` Python 3 submissions of each row as rows with ``text, problem_id, is_correct, language_tag, solution, item``.

    The cut is made on the array, before rows are made.
    """
    title, desc = _string(df, "title"), _string(df, "description")
    pid = F.coalesce(filled(_string(df, "id"), _string(df, "name"), title), F.lit(""))
    subs = F.filter("correct_submissions", lambda s: is_python3_tag(s["language"]) & (F.coalesce(s["code"], F.lit("")) != ""))
    rows = df.select("*", pid.alias("_pid"), title.alias("_title"), desc.alias("_desc"), F.posexplode(F.slice(subs, 1, cap)).alias("item", "_s"))
    return rows.select(
        *df.columns, "item", _contest_text(F.col("_title"), F.col("_pid"), F.col("_desc"), F.col("_s.code")).alias("text"), F.col("_pid").alias("problem_id"),
        F.lit(True).alias("is_correct"), F.lit("python3").alias("language_tag"), F.col("_s.code").alias("solution"),
    )


def expand_parallel(df: DataFrame, cap: int = 8, code: int = 3) -> DataFrame:
    """Like ``expand_contest`` for ``solutions struct<language array<int>, solution array<string>>``; the shorter array counts."""
    name, desc = _string(df, "name"), _string(df, "description")
    lang, sol = F.coalesce("solutions.language", F.array().cast("array<int>")), F.coalesce("solutions.solution", F.array().cast("array<string>"))
    n = F.least(F.size(lang), F.size(sol))
    pairs = F.filter(F.arrays_zip(F.slice(lang, 1, n).alias("language"), F.slice(sol, 1, n).alias("solution")), lambda p: (p["language"] == code) & (F.coalesce(p["solution"], F.lit("")) != ""))
    rows = df.select("*", F.concat(F.lit("dm:"), name).alias("_pid"), name.alias("_title"), desc.alias("_desc"), F.posexplode(F.slice(pairs, 1, cap)).alias("item", "_s"))
    return rows.select(
        *df.columns, "item", _contest_text(F.col("_title"), F.col("_pid"), F.col("_desc"), F.col("_s.solution")).alias("text"), F.col("_pid").alias("problem_id"),
        F.lit(True).alias("is_correct"), F.lit("python3").alias("language_tag"), F.col("_s.solution").alias("solution"),
    )


def parse_solutions(col: Column, is_array: bool) -> Column:
    """Solutions as an array: arrays lose empty entries; of strings, blank and ``[]`` give none, JSON lists their items, JSON scalars and other texts themselves."""
    if is_array:
        return F.filter(F.coalesce(col, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
    s = F.trim(F.coalesce(col, F.lit("")))
    listed = F.from_json(s, "array<string>")
    scalar = F.when(s.rlike(r'^"'), F.get_json_object(F.concat(F.lit('{"v":'), s, F.lit("}")), "$.v"))
    out = F.when((s == "") | (s == "[]"), F.array().cast("array<string>")).when(s.startswith("[") & listed.isNotNull(), listed).otherwise(F.array(F.coalesce(scalar, col)))
    return F.filter(out, lambda x: F.coalesce(x, F.lit("")) != "")


def expand_solution_list(df: DataFrame, source_id: str, cap: int = 8) -> DataFrame:
    """One row per solution of a problem row, at most ``cap``."""
    pid = F.concat(F.lit(f"{source_id}:"), F.coalesce(filled(_string(df, "url"), _string(df, "id"), _string(df, "name")), F.lit("")))
    question = F.coalesce(filled(_string(df, "question"), _string(df, "problem")), F.lit(""))
    sols = parse_solutions(F.col("solutions"), dict(df.dtypes)["solutions"].startswith("array"))
    rows = df.select("*", pid.alias("_pid"), question.alias("_q"), F.posexplode(F.slice(sols, 1, cap)).alias("item", "_s"))
    return rows.select(
        *df.columns, "item", F.concat("_q", F.lit("\n\n# solution\n"), "_s", F.lit("\n")).alias("text"), F.col("_pid").alias("problem_id"),
        F.lit(True).alias("is_correct"), F.lit("python").alias("language_tag"), F.col("_s").alias("solution"),
    )


def expand(df: DataFrame, source_id: str, cap: int = 8) -> DataFrame:
    """Expansion of a source: contest rows without submissions vanish, unknown sources pass through with ``item`` 0."""
    if source_id == CONTEST_SOURCE:
        return expand_contest(df, cap) if "correct_submissions" in df.columns else df.limit(0).withColumn("item", F.lit(0))
    if source_id == "deepmind_code_contests":
        return expand_parallel(df, cap)
    if source_id in ("taco", "apps"):
        return expand_solution_list(df, source_id, cap) if "solutions" in df.columns else df.limit(0).withColumn("item", F.lit(0))
    return df.withColumn("item", F.lit(0))


def extract(df: DataFrame, source_id: str, keep_solution: bool = False) -> DataFrame:
    """``text, problem_id, is_correct, language_tag, solution`` of (expanded) rows of a source.

    Rows of taco and apps that already have a text lose their solution, unless ``keep_solution``.
    """
    text = _string(df, "text")
    solution, pid = _has(df, "solution"), _has(df, "problem_id")
    correct, tag = _has(df, "is_correct", "boolean"), _has(df, "language_tag")
    if source_id in ("taco", "apps"):
        if "solutions" in df.columns:
            joined = F.array_join(parse_solutions(F.col("solutions"), dict(df.dtypes)["solutions"].startswith("array")), "\n\n")
            text = F.coalesce(filled(text, joined), F.lit(""))
        pid = F.coalesce(filled(_string(df, "problem_id"), _string(df, "id")), F.lit(""))
        correct, tag = F.coalesce(correct, F.lit(True)), F.coalesce(tag, F.lit("python"))
        solution = solution if keep_solution else F.lit(None).cast("string")
    elif source_id == MATH_SOURCE:
        solution = F.coalesce(filled(_string(df, "generated_solution"), _string(df, "solution")), F.lit(""))
        problem = F.coalesce(filled(_string(df, "problem"), _string(df, "question")), F.lit(""))
        text, correct = F.concat(problem, F.lit("\n\n"), solution), F.lit(True)
    elif source_id in _EXERCISES:
        problem = F.coalesce(filled(*[_string(df, c) for c in ("prompt", "instruction", "problem", "text")]), F.lit(""))
        solution = F.coalesce(filled(*[_string(df, c) for c in ("canonical_solution", "output", "solution", "code")]), F.lit(""))
        both = (problem != "") & (solution != "")
        text = F.when(both, F.concat(problem, F.lit("\n\n# solution\n"), solution, F.lit("\n"))).when(problem != "", problem).otherwise(solution)
        pid, correct, tag = F.coalesce(filled(_string(df, "task_id"), _string(df, "id")), F.lit("")), F.lit(True), F.lit("python")
    extra = {"text": text, "problem_id": pid.cast("string"), "is_correct": correct, "language_tag": tag, "solution": solution}
    return df.select(*[c for c in df.columns if c not in extra], *[v.alias(k) for k, v in extra.items()])


def make_documents(df: DataFrame, source: dict, collection_date: str, t: Thresholds = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """``(documents, removed)`` from extracted rows with ``doc_id, ord``: empty texts vanish, binary ones are removed with a record."""
    text = F.col("text")
    score = F.col("score").cast("double") if "score" in df.columns and dict(df.dtypes)["score"] in ("double", "float", "int", "bigint") else F.lit(None).cast("double")
    lit = lambda k: F.lit(source.get(k)).cast("string")
    values = {
        "source_id": lit("source_id"), "url": lit("url"), "license": lit("license"), "provenance": lit("provenance"), "collection_date": F.lit(collection_date),
        "language": F.lit("python" if source.get("domain") == "python" else "en"), "domain": lit("domain"), "stem_bucket": lit("stem_bucket"), "quality_score": score,
        "contamination_risk": F.lit("unchecked"), "raw_hash": raw_hash(text), "normalized_hash": normalized_hash(text, t.hash_mode), "token_count": F.lit(None).cast("int"), "status": F.lit("candidate"),
    }
    some = df.where(text != "")
    binary = is_binary(text, t.printable_ratio)
    docs = some.where(~binary).withColumns(values).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DOCUMENT.fields])
    removed = some.where(binary).select("doc_id", lit("source_id").alias("source_id"), F.lit("normalize").alias("stage"), F.array(F.lit("binary")).alias("reason_codes"))
    return docs, removed


def normalize(text: Column, is_text: Column | None = None, t: Thresholds = DEFAULT) -> Column:
    """``struct<text, reason>``: the text as it is, or null with the reason ``not_text`` (null, or ``is_text`` false) or ``binary``."""
    known = text.isNotNull() if is_text is None else F.coalesce(is_text, F.lit(False)) & text.isNotNull()
    reason = F.when(~known, "not_text").when(is_binary(text, t.printable_ratio), "binary")
    return F.struct(F.when(reason.isNull(), text).alias("text"), reason.alias("reason"))


def documents_in_memory(spark: SparkSession, rows: list[dict], source: dict, collection_date: str, *, cap: int = 8, t: Thresholds = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """``(documents, removed)`` of rows at hand; ids ``source:number`` count rows after expansion, before empty and binary ones are dropped."""
    df = spark.createDataFrame([{**r, "row": k} for k, r in enumerate(rows)]) if rows else spark.createDataFrame([], "row bigint, text string")
    got = number_rows(expand(df, source["source_id"], cap).withColumn("_at", F.struct("row", "item")), "_at", "_n").drop("_at")
    ident = F.format_string("%s:%08d", F.lit(source["source_id"]), F.col("_n"))
    got = extract(got.withColumn("doc_id", ident).withColumn("ord", F.col("_n")).drop("_n"), source["source_id"])
    return make_documents(got, source, collection_date, t)


def number_rows(df: DataFrame, order: str | None = None, name: str = "row") -> DataFrame:
    """Add ``name``: a dense row number. With ``order`` numbers follow that column, else the order of the files.

    Two levels: numbers within partitions, then offsets from the partitions' sizes (one row a partition), so no
    single task sees all rows.
    """
    key = F.col(order) if order else F.monotonically_increasing_id()
    parts = df.withColumn("_k", key)
    parts = parts.repartitionByRange(max(1, df.rdd.getNumPartitions()), "_k") if order else parts
    parts = parts.withColumn("_p", F.spark_partition_id())
    parts = checkpoint(parts)
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    base = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy("_k")) - 1
    return parts.join(F.broadcast(base), "_p").withColumn(name, F.col("_base") + within).drop("_p", "_k", "_base")


def documents_of(df: DataFrame, source: dict, collection_date: str, *, row: str = "row", cap: int = 8, t: Thresholds = DEFAULT, max_docs: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Expand, extract and construct the documents of one source; ids are ``source:row:item``.

    ``row`` numbers the raw rows. ``max_docs`` keeps the first documents in that order.
    """
    sid = source["source_id"]
    rows = extract(expand(df, sid, cap), sid)
    ident = F.format_string("%s:%06d:%02d", F.lit(sid), F.col(row).cast("bigint"), F.col("item").cast("bigint"))
    rows = rows.withColumn("doc_id", ident).withColumn("ord", F.col(row).cast("bigint") * 1000 + F.col("item"))
    docs, removed = make_documents(rows, source, collection_date, t)
    return (docs.orderBy("ord").limit(max_docs) if max_docs is not None else docs), removed


def with_reason(df: DataFrame) -> DataFrame:
    """Add ``_why``, the reason for which ``ingest_filter`` removes a row, null for rows that stay."""
    tag = F.lower(F.coalesce(F.when(F.col("language_tag") != "", F.col("language_tag")), F.lit("python")))
    why = F.when(F.col("is_correct") == F.lit(False), "incorrect_solution").when(~tag.isin("python", "python3", "py"), "not_python")
    return df.withColumn("_why", F.when(F.col("source_id") == CONTEST_SOURCE, why))


def ingest_filter(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contest rows that are known wrong or not Python go; a null ``is_correct`` passes, a null tag is Python."""
    marked = with_reason(df)
    removed = marked.where("_why is not null").select("doc_id", "source_id", F.lit("ingest").alias("stage"), F.array("_why").alias("reason_codes"))
    return marked.where("_why is null").drop("_why"), removed
