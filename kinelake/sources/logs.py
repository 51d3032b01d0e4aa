"""Readers for raw motion, marker, event, survey and metadata logs.

Subjects are whole file sets: one scan reads every file of a kind and takes the subject from the file
path. Only headers and a few leading lines are looked at on the driver.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.operators import ordering

#: A header line is looked for in so many leading bytes of a file.
HEADER_BYTES = 1 << 16


def number(c: str) -> Column:
    """Numeric-or-NULL."""
    return F.expr(f"try_cast(trim(`{c}`) AS DOUBLE)")


def encodings(spark: SparkSession, paths: str | list[str]) -> dict[tuple[str, str], list[str]]:
    """Group files by (encoding, first line); UTF-16 by its byte-order mark, else UTF-8. Empty files are left out.

    First lines stream by, so a file may have any size; of each file one line is kept.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    at = F.col("_metadata.file_path").alias("at")  # escaped, so only the key of the join
    files = spark.read.format("binaryFile").load(paths).select(at, "path")  # names only: contents are not fetched
    lines = spark.read.text(paths).select(at, F.col("value").cast("binary").alias("bytes"), F.monotonically_increasing_id().alias("_id"), F.col("_metadata.file_block_start").alias("_at"))
    heads = lines.filter("_at = 0").groupBy("at").agg(F.min_by(F.substring("bytes", 1, HEADER_BYTES), "_id").alias("head"))
    mark = F.hex(F.substring("head", 1, 2))
    kind = F.when(mark.isin("FFFE", "FEFF"), "UTF-16").otherwise("UTF-8")
    # The line only tells headers apart, so its bytes are read as Latin-1, which knows no broken character.
    line = F.decode("head", "ISO-8859-1")
    groups = files.join(heads, "at").select("path", kind.alias("enc"), line.alias("line"))
    groups = groups.groupBy("enc", "line").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return {(r["enc"], r["line"]): r["paths"] for r in groups.orderBy("enc", "line").collect()}  # file names only


def read_csv_any(spark: SparkSession, paths: str | list[str], header: bool = True) -> DataFrame | None:
    """CSV as strings with blank-stripped headers; UTF-8 and UTF-16 files are read side by side.

    Files are read by header, so each one's columns go by its own first line. A path that does not exist is an absent
    table (None); any other failure is raised.
    """
    parts = None
    try:
        groups = encodings(spark, paths)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    by_kind: dict[tuple[str, str], list[str]] = {}
    for (enc, line), files in groups.items():
        by_kind.setdefault((enc, line if header else ""), []).extend(files)
    for (enc, _), files in by_kind.items():
        df = (
            spark.read.option("header", header).option("encoding", enc).option("multiLine", enc == "UTF-16")
            .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(files)
        )
        df = df.toDF(*[c.strip().lstrip("﻿") for c in df.columns]).withColumn("_file", F.col("_metadata.file_path"))
        parts = df if parts is None else parts.unionByName(df, allowMissingColumns=True)
    return parts


def validate_columns(df: DataFrame, required: list[str], min_rows: int = 1) -> DataFrame:
    """Raise when columns are missing or fewer than ``min_rows`` rows exist."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    if min_rows and df.limit(min_rows).count() < min_rows:
        raise ValueError(f"fewer than {min_rows} rows")
    return df


def subject_of_path(path: Column | str = "_file") -> Column:
    """``.../px/PX12/PlayerMovement.csv`` or ``.../PX12/..`` -> ``PX12`` (likewise fx)."""
    return F.regexp_extract(path, r"(?i)/((?:px|fx)\d+)(?:/|_|\.)", 1)


def discover_subjects(spark: SparkSession, pattern: str) -> DataFrame:
    """(subject_id, grp, number) found under a path glob, in numeric order."""
    files = spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("_file"))
    s = files.select(subject_of_path().alias("subject_id")).filter("subject_id <> ''").distinct()
    grp = F.when(F.lower("subject_id").startswith("fx"), "control").otherwise("patient")
    num = F.regexp_extract("subject_id", r"(\d+)", 1).cast("int")
    return s.select("subject_id", grp.alias("grp"), num.alias("number")).orderBy("grp", "number")


def movement_log(df: DataFrame, time: str, columns: list[str]) -> DataFrame:
    """Numeric frames: required columns only, rows without a numeric time dropped, NaN turned to NULL."""
    validate_columns(df, [time, *columns], 0)
    value = lambda c: F.nanvl(number(c), F.lit(None).cast("double")).alias(c)
    keep = ["_file"] if "_file" in df.columns else []
    extra = ["subject_id"] if "subject_id" in df.columns else []
    return df.select(*extra, *keep, value(time).alias("t"), *[value(c) for c in columns]).filter("t IS NOT NULL")


def marker_log(df: DataFrame, strict: bool = False) -> DataFrame:
    """(subject.., ts, name, row_no) with the columns found by substring, or by exact name if strict."""
    find = {}
    for c in df.columns:
        low = c.lower().strip()
        for key, want in (("time", "timestamp"), ("name", "name")):
            if (low == want) if strict else (key in low and not low.startswith("_")):
                find.setdefault(key, c)
    if set(find) != {"time", "name"}:
        raise ValueError(f"marker log needs time and name columns; found {df.columns}")
    keep = [c for c in ("subject_id", "_file", "row_no") if c in df.columns]
    return df.select(*keep, number(find["time"]).alias("ts"), F.trim(find["name"]).alias("name"))


def event_log(df: DataFrame) -> DataFrame:
    """snake_case headers, required columns, optional progress and hand_used, trimmed text, valid times."""
    df = df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])
    missing = {"timestamp", "event", "subject_id"} - set(df.columns)
    if missing:
        raise ValueError(f"event log lacks {sorted(missing)}")
    opt = {c: (F.trim(c) if c in df.columns else F.lit(None).cast("string")) for c in ("progress", "hand_used")}
    return df.select(
        number("timestamp").alias("timestamp"),
        F.trim("event").alias("event"),
        opt["progress"].cast("double").alias("progress"),
        opt["hand_used"].alias("hand_used"),
        F.trim("subject_id").alias("subject_id"),
    ).filter("timestamp IS NOT NULL")


def read_new_recordings(spark: SparkSession, path: str, channels: list[str]) -> DataFrame:
    """One file or a folder of headered and headerless recordings, mixed as they come; the subject is the file stem.

    Each file's own first line tells its layout: it is a header when one of its cells is no number, and the file has a
    time column when it has more cells than there are channels. The line's facts travel along the file as a running
    minimum, so no file is looked at beforehand; sizes in bytes bound the number of rows. Blank lines are skipped, cells
    that are missing or no numbers are NULL, and a file without rows gives none.
    """
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("subject_id")
    sizes = spark.read.format("binaryFile").load(path).select(stem, "length").groupBy("subject_id").agg(F.sum("length").alias("n"))
    most = (sizes.agg(F.max("n")).first()[0] or 0) // 2 + 1  # a row has two bytes or more
    lines = spark.read.text(path).select(
        stem, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_row"), "value"
    )
    cells = F.split("value", ",")
    lines = lines.filter(F.trim("value") != "").withColumn("_cells", F.transform(cells, lambda c: F.trim(c)))
    numeric = F.forall("_cells", lambda c: c.try_cast("double").isNotNull())
    first = F.struct("_at", "_row", F.size("_cells").alias("width"), numeric.alias("numeric"))
    order = ["_file", "_at", "_row"]
    x = ordering.cumulate(lines, ["subject_id", "_file"], F.col("_at"), order, {"_first": first}, max_rows=most, kind="min")
    header = (F.col("_at") == F.col("_first._at")) & (F.col("_row") == F.col("_first._row")) & ~F.col("_first.numeric")
    timed = F.when(F.col("_first.width") > len(channels), 1).otherwise(0)
    value = lambda at: F.get("_cells", at).try_cast("double")
    x = x.filter(~header).select(
        "subject_id", *order, F.when(timed == 1, value(F.lit(0))).alias("t"), *[value(timed + i).alias(c) for i, c in enumerate(channels)]
    )
    return ordering.position(x, ["subject_id"], F.col("_at"), order, max_rows=most).drop(*order)


def metadata_table(spark: SparkSession, path: str, wanted: list[str], probe: int = 6) -> DataFrame:
    """Metadata of one file whose header sits somewhere in the first ``probe`` lines.

    What stands up to the header is dropped by position, so a data line that equals one of those lines stays.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
    first = text.filter("_at = 0").orderBy("_id").limit(probe).collect()  # at most ``probe`` lines
    head = [r["value"] for r in first]
    low = {w.lower() for w in wanted}
    at = next((i for i, l in enumerate(head) if low & {c.strip().lower() for c in l.split(",")}), None)
    if at is None:
        raise ValueError(f"no header with {wanted} in the first {probe} lines")
    names = [c.strip().lstrip("﻿") for c in head[at].split(",")]
    lines = text.filter(((F.col("_at") > 0) | (F.col("_id") > first[at]["_id"])) & (F.trim("value") != ""))
    cells = F.from_csv("value", ", ".join(f"`{n}` STRING" for n in names))
    return lines.select(cells.alias("r")).select("r.*")


def survey_log(df: DataFrame) -> DataFrame:
    """(subject_id, q, row_no, response) from header or headerless three-column logs; blank rows skipped."""
    cols = [c for c in df.columns if c not in ("_file", "subject_id", "row_no")]
    q = F.regexp_extract(F.upper(F.trim(F.col(cols[1]))), r"^Q(\d+)$", 1)
    keep = [c for c in ("subject_id", "_file", "row_no") if c in df.columns]
    out = df.select(*keep, q.alias("q"), F.trim(F.col(cols[2])).alias("response"))
    return out.filter((F.col("q") != "") & F.col("response").isNotNull()).withColumn("q", F.col("q").cast("int"))


def subject_files(movement: DataFrame, markers: DataFrame | None, survey: DataFrame | None, roster: DataFrame) -> DataFrame:
    """Roster with row counts of each file kind; a subject without a file keeps NULL."""
    out = roster
    for name, df in (("movement", movement), ("markers", markers), ("survey", survey)):
        if df is None:
            out = out.withColumn(f"n_{name}", F.lit(None).cast("long"))
            continue
        c = df.groupBy("subject_id").agg(F.count(F.lit(1)).alias(f"n_{name}"))
        out = out.join(c, "subject_id", "left")
    return out
