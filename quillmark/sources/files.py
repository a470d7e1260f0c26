"""File sources: notes, codes, scores, rules. Schemas are explicit and all-string where the files are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.codes import norm, pipe_split
from ..functions.dates import compact_date, deleted_date, in_force, julian_date

# Names under which note files carry ids and texts, first match wins.
ID_NAMES = ("NOTE_ID", "note_id", "note_index")
TEXT_NAMES = ("NOTE_TEXT", "note_text", "text")


def read_csv(spark: SparkSession, path: str | list[str], recursive: bool = False, columns: list[str] | None = None, required: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """CSV (also gzipped) with a header, every column a string, quoted newlines allowed, blanks around column names dropped.

    ``columns`` alone are read; a lack of those or of ``required`` ones is an error. A gzipped or multi-line file is one task however large
    it is: ``parts`` deals its rows to as many partitions for what follows."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', recursiveFileLookup=recursive, pathGlobFilter="*.csv*" if recursive else None)
    df = df.toDF(*[c.strip() for c in df.columns])
    lacking = [c for c in (*(columns or ()), *required) if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns {lacking}; there are {df.columns}")
    df = df.select(*columns) if columns else df
    return df.repartition(parts) if parts else df


def read_billing(spark: SparkSession, path, parts: int | None = None) -> DataFrame:
    """hadm_id, subject_id, hcpcs_cd of a billing table: codes trimmed and upper-cased, blank ones dropped; a lack of a column is an error."""
    df = read_csv(spark, path, columns=["hadm_id", "subject_id", "hcpcs_cd"], parts=parts)
    return df.withColumn("hcpcs_cd", norm(F.col("hcpcs_cd"))).where("hcpcs_cd <> ''")


def resolve(columns: list[str], candidates, given: str | None = None) -> str:
    if given is not None:
        if given not in columns:
            raise ValueError(f"no column {given}; there are {columns}")
        return given
    for c in candidates:
        if c in columns:
            return c
    raise ValueError(f"none of {tuple(candidates)} among {columns}")


def read_notes(spark: SparkSession, path, id_col: str | None = None, text_col: str | None = None, limit: int | None = None) -> DataFrame:
    """Notes with note_id (trimmed) and note_text (null is empty); other columns pass. A limit takes the first by note_id."""
    df = read_csv(spark, path)
    i, t = resolve(df.columns, ID_NAMES, id_col), resolve(df.columns, TEXT_NAMES, text_col)
    df = df.withColumnRenamed(i, "note_id").withColumnRenamed(t, "note_text").withColumn("note_id", F.trim("note_id")).withColumn("note_text", F.coalesce("note_text", F.lit("")))
    return df.orderBy("note_id").limit(limit) if limit is not None else df


def code_sets(df: DataFrame, codes: str, note_id: str = "note_id") -> DataFrame:
    """note_id, code of a pipe-joined column; of rows with the same id the last in the file counts."""
    last = df.select(F.trim(note_id).alias("note_id"), F.col(codes).alias("codes"), F.monotonically_increasing_id().alias("row")).groupBy("note_id").agg(F.max_by("codes", "row").alias("codes"))
    return last.select("note_id", F.explode(pipe_split(F.col("codes"))).alias("code")).distinct()


def read_gold(spark: SparkSession, path, codes: str = "proc_codes") -> DataFrame:
    df = read_csv(spark, path)
    return code_sets(df, codes, resolve(df.columns, ID_NAMES))


def read_predictions(spark: SparkSession, path) -> DataFrame:
    """note_id, code, score, pos of pred_codes and pred_scores; scores of another length, or unreadable, are all 1."""
    df = read_csv(spark, path)
    if "pred_scores" not in df.columns:
        df = df.withColumn("pred_scores", F.lit(None).cast("string"))
    codes = pipe_split(F.col("pred_codes"))
    scores = F.transform(F.filter(F.split(F.coalesce("pred_scores", F.lit("")), r"\|"), lambda x: F.trim(x) != ""), lambda x: x.try_cast("double"))
    good = (F.size(scores) == F.size(codes)) & ~F.exists(scores, lambda x: x.isNull())
    scores = F.when(good, scores).otherwise(F.transform(codes, lambda c: F.lit(1.0)))
    return df.select(F.trim("note_id").alias("note_id"), F.posexplode(F.arrays_zip(codes.alias("code"), scores.alias("score"))).alias("pos", "x")).select("note_id", "x.code", "x.score", (F.col("pos") + 1).alias("pos"))


def read_pools(spark: SparkSession, paths: list[str]) -> DataFrame:
    """note_id, code of files with pred_codes or with a code a row."""
    out = None
    for p in paths:
        df = read_csv(spark, p)
        one = code_sets(df, "pred_codes") if "pred_codes" in df.columns else df.select(F.trim("note_id").alias("note_id"), norm(F.col("code")).alias("code")).where("code <> ''")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def llm_sources(df: DataFrame, keep: tuple[str, ...] = ("llm",)) -> DataFrame:
    """note_id, code, rank, confidence of rows of kept sources: bad ranks are 0, blank confidences null; the best rank of a code."""
    rank = F.coalesce(F.col("llm_rank").try_cast("double").cast("int"), F.lit(0))
    x = df.where(F.col("source").isin(*keep)).select(F.trim("note_id").alias("note_id"), norm(F.col("code")).alias("code"), rank.alias("rank"), F.col("llm_confidence").try_cast("double").alias("confidence"))
    return x.groupBy("note_id", "code").agg(F.min("rank").alias("rank"), F.min_by("confidence", "rank").alias("confidence"))


def read_npz(spark: SparkSession, path, top: int = 1000) -> DataFrame:
    """note_id, code, score, pos of score archives, ragged (candidate_codes, lengths, probs) or dense (labels, scores; the ``top``
    best labels a note). An archive is unpacked by an executor, note by note; only its bytes are held whole."""
    import io

    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                z = np.load(io.BytesIO(content), allow_pickle=False)
                dense, ends = "scores" in z, np.cumsum(z["lengths"]) if "lengths" in z else None
                labels, values, notes = (z["labels"], z["scores"], z["note_ids"]) if dense else (z["candidate_codes"], z["probs"], z["note_ids"])
                for i, note in enumerate(notes):
                    at = np.argsort(-values[i], kind="stable")[:top] if dense else np.arange(ends[i - 1] if i else 0, ends[i])
                    score = (values[i] if dense else values)[at].astype(float)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([str(note)] * len(at), pa.string()), pa.array([str(x).strip().upper() for x in labels[at]], pa.string()), pa.array(score), pa.array(np.arange(1, len(at) + 1))], ["note_id", "code", "score", "pos"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "note_id string, code string, score double, pos long")


KB_COLUMNS = ["code_system", "code", "code_description", "code_lay_term", *[x for i in range(1, 7) for x in (f"code_range_{i}", f"code_range_{i}_description")]]


def read_kb_codes(spark: SparkSession, path) -> DataFrame:
    """The code list alone: distinct, upper-cased; no other column is read."""
    return read_csv(spark, path, columns=["code"]).select(norm(F.col("code")).alias("code")).where("code <> ''").distinct()


def read_kb(spark: SparkSession, path) -> DataFrame:
    """Knowledge base, code upper-cased, the first row of a code in file order kept."""
    df = read_csv(spark, path).withColumn("code", norm(F.col("code"))).withColumn("_row", F.monotonically_increasing_id())
    return df.withColumn("_i", F.row_number().over(Window.partitionBy("code").orderBy("_row"))).where("_i = 1 and code <> ''").drop("_i", "_row")


def merge_kb(base: DataFrame, licensed: DataFrame) -> DataFrame:
    """The licensed rows, and those of the base whose code it lacks."""
    return base.join(licensed.select("code"), "code", "left_anti").unionByName(licensed, allowMissingColumns=True)


def kb_problems(kb: DataFrame, systems: tuple[str, ...] = ("CPT", "HCPCS")) -> DataFrame:
    """problem, code, n: every breach of the knowledge-base contract."""
    missing = [c for c in ("code_system", "code", "code_description") if c not in kb.columns]
    spark = kb.sparkSession
    out = spark.createDataFrame([(f"missing column {c}", None, 1) for c in missing], "problem string, code string, n long")
    if missing:
        return out
    c = F.coalesce(F.trim("code"), F.lit(""))
    tests = {"blank code": c == "", "lowercase code": c != F.upper(c), "blank description": F.trim(F.coalesce("code_description", F.lit(""))) == "", "unknown system": ~F.coalesce(F.col("code_system").isin(*systems), F.lit(False))}
    rows = kb.select(F.col("code").alias("code"), F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))).alias("problem")).groupBy("problem", "code").agg(F.count("*").alias("n"))
    dup = kb.where(c != "").groupBy("code").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate code").alias("problem"), "code", "n")
    return out.unionByName(rows).unionByName(dup)


# --- rule files ------------------------------------------------------------------------------------------------------


def read_ptp(spark: SparkSession, path) -> DataFrame:
    """Tab-separated edits; rows whose sixth field is no number, the header lines among them, are dropped. Copies of a file
    under names that differ in case count once."""
    f = F.split(F.col("value"), "\t")
    x = spark.read.text(path, recursiveFileLookup=True).select("value", F.lower(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).alias("name"), F.col("_metadata.file_path").alias("path"))
    first = x.groupBy("name").agg(F.min("path").alias("path"))
    x = x.join(first, ["name", "path"], "left_semi").where(F.size(f) >= 6)
    g = lambda i: F.trim(F.get(f, F.lit(i)))
    return x.select(norm(g(0)).alias("col1"), norm(g(1)).alias("col2"), compact_date(g(3)).alias("effective"), compact_date(g(4)).alias("deletion"), g(5).try_cast("int").alias("ccmi"), g(6).alias("rationale")).where("ccmi is not null")


def ptp_in_force(on: str) -> Column:
    return in_force(F.lit(on).cast("date"), F.col("effective"), F.col("deletion"))


def active_ptp(ptp: DataFrame, on: str) -> DataFrame:
    return ptp.where(ptp_in_force(on))


def read_aoc(spark: SparkSession, path, strict: bool = False) -> DataFrame:
    """Fixed-width add-on file. An add-on field of six characters is the edit type and the code, unless ``strict`` takes it whole."""
    v = F.col("value")
    cut = lambda a, n: F.trim(F.substring(v, a + 1, n))
    addon = cut(0, 6)
    addon = addon if strict else F.when(F.length(addon) == 6, F.substring(addon, 2, 5)).otherwise(addon)
    x = spark.read.text(path).where(F.length("value") >= 32).select(
        norm(addon).alias("addon"), norm(cut(6, 7)).alias("primary_field"), julian_date(cut(18, 7)).alias("addon_deletion"), julian_date(cut(25, 7)).alias("primary_deletion"), julian_date(cut(32, 7)).alias("effective"), F.trim(F.expr("substring(value, 40)")).alias("description"), cut(13, 5).alias("extra"),
    )
    three = F.col("primary_field").contains("CCCCC") | F.col("extra").contains("CCCCC")
    return x.select("addon", F.when(~three, F.substring("primary_field", 1, 5)).alias("primary"), "addon_deletion", "primary_deletion", "effective", F.when(three, 3).otherwise(1).alias("aoc_type"), "description")


def aoc_in_force(on: str) -> Column:
    d = F.lit(on).cast("date")
    return in_force(d, F.col("effective"), F.col("addon_deletion")) & in_force(d, F.lit(None).cast("date"), F.col("primary_deletion"))


def active_aoc(aoc: DataFrame, on: str) -> DataFrame:
    return aoc.where(aoc_in_force(on))


def aoc_lookup(aoc: DataFrame) -> tuple[DataFrame, DataFrame]:
    return aoc.where("aoc_type = 1").select("addon", "primary").distinct(), aoc.where("aoc_type = 3").select("addon").distinct()


def read_mue(spark: SparkSession, path) -> DataFrame:
    """Unit limits of a CSV with a preamble: rows that begin with a code and a whole number; the indicator is its leading digit."""
    s = T.StructType([T.StructField(c, T.StringType()) for c in ("code", "max_units", "indicator", "rationale")])
    df = spark.read.csv(path, schema=s, header=False, multiLine=True, escape='"')
    return df.where(norm(F.col("code")).rlike(r"^[A-Z0-9]{5}$") & F.trim("max_units").rlike(r"^\d+$")).select(
        norm(F.col("code")).alias("code"), F.trim("max_units").try_cast("long").alias("max_units"), F.regexp_extract(F.coalesce("indicator", F.lit("")), r"^\s*(\d)", 1).try_cast("int").alias("mai"), "rationale")


def read_history(spark: SparkSession, changes, deletions) -> tuple[DataFrame, DataFrame]:
    """Annual changes and dated deletions; a file without its columns is an error."""
    a, b = read_csv(spark, changes), read_csv(spark, deletions)
    for df, need in ((a, ("code", "year", "change_type", "crosswalk_code")), (b, ("code", "deleted_date", "substitute_code"))):
        lacking = [c for c in need if c not in df.columns]
        if lacking:
            raise ValueError(f"missing columns {lacking}")
    a = a.select(norm(F.col("code")).alias("code"), F.lower(F.trim("change_type")).alias("change_type"), F.col("year").try_cast("int").alias("year"), norm(F.col("crosswalk_code")).alias("crosswalk_code")).where("code <> '' and year is not null")
    return a, b.select(norm(F.col("code")).alias("code"), deleted_date(F.col("deleted_date")).alias("deleted_date"), norm(F.col("substitute_code")).alias("substitute_code"))


def read_bins(spark: SparkSession, path) -> DataFrame:
    return read_csv(spark, path).select(norm(F.col("code")).alias("code"), F.lower(F.trim("bin")).alias("bin"))


def read_tiers(spark: SparkSession, path) -> DataFrame:
    return read_csv(spark, path).select(F.trim("note_id").alias("note_id"), F.lower(F.trim("tier")).alias("tier"))


def read_calibration(spark: SparkSession, path) -> tuple[float, DataFrame]:
    """Default threshold, and code, thr of the overrides."""
    df = spark.read.schema("default_threshold double, per_code map<string,double>").json(path, multiLine=True)
    return df.first()["default_threshold"], df.select(F.explode("per_code").alias("code", "thr"))


def read_jsonl(spark: SparkSession, path, schema) -> DataFrame:
    """JSON lines; blank ones are skipped, a bad one is an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")
