"""Sources and sinks: chunks, cases and results as JSON, run artefacts, reports with replaceable sections, resumable results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.chunking import CHUNKS
from lodestone.operators.common import ranked


def corpus(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """(path, doc_id, source, content) of all files under a folder with that suffix, case aside, by path; the id is of the name alone. ValueError if there are none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    found = files.filter(F.lower("path").endswith(suffix.lower()))
    if not found.select("path").limit(1).count():
        raise ValueError(f"no {suffix} files under {folder}")
    return found.select("path", T.doc_id(name).alias("doc_id"), name.alias("source"), "content").orderBy("path")


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of JSON lines, blank ones aside. A line without id or text raises an error, as does an empty source; a missing index is read from the id, missing table columns are empty."""
    raw = spark.read.schema(CHUNKS).json(path)
    bad = raw.filter("chunk_id is null or text is null").limit(1).count()
    if bad or not raw.limit(1).count():
        raise ValueError("chunks need an id and a text" if bad else "no chunks")
    empty = F.array().cast("array<string>")
    rows = F.array().cast("array<map<string,string>>")
    return raw.withColumn("chunk_index", T.index_of_chunk("doc_id", "chunk_id", "chunk_index")).withColumns({"table_caption": F.coalesce("table_caption", F.lit("")), "table_headers": F.coalesce("table_headers", empty), "table_rows": F.coalesce("table_rows", rows), "chunk_type": F.coalesce("chunk_type", F.lit("paragraph"))})


def read_cases(spark: SparkSession, path: str, version: str = "2.0", ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A row for each case of a dataset of that version; ids and limit narrow them."""
    whole = spark.read.option("multiLine", True).json(path)
    if whole.filter(F.col("dataset_schema_version") != version).limit(1).count():
        raise ValueError(f"dataset_schema_version is not {version}")
    cases = whole.select(F.explode("cases").alias("c")).select("c.*")
    cases = cases.filter(F.col("id").isin(ids)) if ids else cases
    return cases.limit(limit) if limit else cases


def discover(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Run artefacts of that name anywhere under a folder, one row each with its path, by path; unreadable ones are skipped."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("multiLine", True).option("mode", "DROPMALFORMED").json(folder)
    return found.withColumn("path", F.regexp_replace(F.input_file_name(), "^file:/+", "/")).dropDuplicates(["path"]).orderBy("path")


def upsert_section(report: str, start: str, end: str, section: str) -> str:
    """report with what stands from marker start to marker end replaced by the section, or with it appended."""
    block = f"{start}\n{section.strip()}\n{end}"
    head, found, rest = report.partition(start)
    _, closed, tail = rest.partition(end)
    return head + block + tail if found and closed else f"{report.rstrip()}\n\n{block}\n".lstrip()


def resume(cases: DataFrame, previous: DataFrame, config: dict, previous_config: dict, key: str = "case_id") -> tuple[DataFrame, DataFrame]:
    """(to do, to reuse): earlier results of the same cases, if every setting is the same; else none."""
    if config != previous_config:
        return cases, previous.limit(0)
    return cases.join(previous.select(key), key, "left_anti"), previous.join(cases.select(key), key, "left_semi")


def _runs(spark: SparkSession, path: str) -> DataFrame:
    """(n_rows, run) of the runs under path that were written whole."""
    try:
        return spark.read.schema("n_rows long, run int").parquet(f"{path}/runs")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "n_rows long, run int")


def append_results(rows: DataFrame, path: str, run: int | None = None) -> int:
    """Results of some cases added as a run, by default one after the last, whose number is returned. A run counts once its row under runs stands, which is written last; one that failed before counts nowhere and its number is
    written again, as is a run whose number is given."""
    spark = rows.sparkSession
    if run is None:
        run = (_runs(spark, path).agg(F.max("run")).first()[0] or 0) + 1
    rows.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").json(f"{path}/rows")
    n = read_run(spark, path, run).count()
    spark.createDataFrame([(n, run)], "n_rows long, run int").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{path}/runs")
    return run


def read_run(spark: SparkSession, path: str, run: int) -> DataFrame:
    return spark.read.json(f"{path}/rows").filter(F.col("run") == run)


def read_results(spark: SparkSession, path: str, key: str = "case_id") -> DataFrame | None:
    """The last result of each case, by the number of its run; of equal cases in a run the largest row. None if no run counts."""
    runs = [r["run"] for r in _runs(spark, path).select("run").collect()]
    if not runs:
        return None
    rows = spark.read.json(f"{path}/rows").filter(F.col("run").isin(runs))
    whole = F.to_json(F.struct(*[c for c in rows.columns if c != "run"]))
    return ranked(rows.withColumn("_row", whole), [key], [F.col("run").desc(), F.col("_row").desc()], "_at").filter("_at = 1").drop("_row", "_at", "run")


def payload(chunks: DataFrame) -> DataFrame:
    """Chunks as they are stored: table columns only where a chunk has a table, null elsewhere, so that JSON leaves them out."""
    table = [c for c in chunks.columns if c.startswith("table_")]
    return chunks.withColumns({c: F.when(F.col("chunk_type") == "table", F.col(c)) for c in table})


def as_evidence(rows: DataFrame, round_no: int = 0) -> DataFrame:
    """Stored chunks or hits as passages: what they lack, or have null, is the default."""
    kinds = {"doc_id": "string", "chunk_index": "int", "title": "string", "section": "string", "page_start": "int", "page_end": "int", "chunk_type": "string", "table_caption": "string", "table_headers": "array<string>", "table_rows": "array<map<string,string>>", "table_row_start": "int", "table_row_end": "int", "fusion_score": "double", "rerank_score": "double", "is_neighbor": "boolean", "seed_chunk_id": "string", "round": "int"}
    plain = {"chunk_type": F.lit("paragraph"), "is_neighbor": F.lit(False), "round": F.lit(round_no)}
    empty = {"string": F.lit(""), "int": F.lit(0), "double": F.lit(0.0), "array<string>": F.array().cast("array<string>"), "array<map<string,string>>": F.array().cast("array<map<string,string>>")}
    have = rows.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in rows.columns})
    have = have.withColumn("chunk_index", T.index_of_chunk(F.coalesce("doc_id", F.lit("")), "chunk_id", "chunk_index"))
    return have.select("chunk_id", "source", *(F.coalesce(F.col(c), plain.get(c, empty.get(k))).alias(c) for c, k in kinds.items()), "text")


def write_report(rows: DataFrame, path: str, fmt: str = "json") -> None:
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def write_markdown(blocks: DataFrame, path: str) -> None:
    """A text file of Markdown for each document, under its name, blocks in order and pages marked."""
    from pyspark.sql import Window

    before = F.lag("page_start").over(Window.partitionBy("doc_id").orderBy("seq"))
    marked = blocks.withColumn("text", F.when(F.col("page_start") > before, F.concat(F.lit("<!-- page break -->\n\n"), "text")).otherwise(F.col("text")))
    whole = marked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("all"))
    whole.select("doc_id", F.array_join(F.transform("all", lambda b: b["text"]), "\n\n").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)
