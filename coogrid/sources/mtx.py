"""Matrix Market text.

A path is one matrix: a file, or a folder of part files as Spark writes them.
Lines are ordered by (file, block start, row id inside the block), so the header is
found by one aggregation however the file is split, and the same aggregation
checks the body.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..matrix import COL, ROW, VAL, Matrix
from ..operators.build import mirror
from ..plans.durable import materialize
from ..plans.skew import BROADCAST_KEYS

_HEADER_PART = "0-header"  # sorts before the entries folder
_BODY_PART = "1-entries"


def _lines(spark: SparkSession, path: str, matrix_id: str) -> DataFrame:
    """Non-blank lines as ``matrix_id, line, at``; ``at`` grows along the text."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    at = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    # White space of any kind around a line means nothing.
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    lines = raw.select(F.lit(matrix_id).alias("matrix_id"), line.alias("line"), at.alias("at"))
    return lines.where(F.col("line") != "")


def _token(i: int) -> Column:
    return F.get(F.split("line", r"\s+"), F.lit(i))


def _index(i: int) -> Column:
    return F.expr(f"try_cast(get(split(line, '\\\\s+'), {i}) AS BIGINT)")


def _survey(lines: DataFrame) -> list:
    """One row per matrix: header, counts and extreme indices, from a single pass.

    The header takes part in the extremes: it states the largest legal indices, so
    the maxima exceed it exactly when an entry does.
    """
    comment = F.col("line").startswith("%")
    body = F.when(~comment, F.col("at"))
    return (
        lines.groupBy("matrix_id")
        .agg(
            F.min_by("line", body).alias("header"),
            F.min(body).alias("header_at"),
            F.max(F.when(comment, F.col("at"))).alias("last_comment"),
            F.count(body).alias("stated"),
            F.count_if(~comment & (F.size(F.split("line", r"\s+")) == 3)).alias("triples"),
            F.count_if(~comment & (_index(0).isNull() | _index(1).isNull())).alias("garbled"),
            F.min(F.when(~comment, F.least(_index(0), _index(1)))).alias("low"),
            F.max(F.when(~comment, _index(0))).alias("top_row"),
            F.max(F.when(~comment, _index(1))).alias("top_col"),
        )
        .collect()  # one row per matrix
    )


def _check(info, lines: DataFrame) -> tuple[int, int, int]:
    """Shape and entry count of a surveyed matrix, or an error that shows bad lines."""
    tokens = (info["header"] or "").split()
    name = info["matrix_id"]
    if len(tokens) < 3 or not all(t.isdigit() for t in tokens[:3]):
        raise ValueError(f"{name}: no header line with rows, columns and entries")
    nrows, ncols, nnz = (int(t) for t in tokens[:3])
    late = info["last_comment"] is not None and tuple(info["last_comment"]) > tuple(info["header_at"])
    outside = nnz > 0 and info["stated"] > 1 and (info["low"] or 0) < 1
    outside = outside or (info["top_row"] or 0) > nrows or (info["top_col"] or 0) > ncols
    if late or outside or info["garbled"]:
        r, c = _index(0), _index(1)
        good = (r >= 1) & (r <= nrows) & (c >= 1) & (c <= ncols)
        own = lines.where(F.col("matrix_id") == name)
        # A comment after the header is at fault itself; those before it are not.
        if info["header_at"] is not None:
            place = F.struct(*(F.lit(v).alias(k) for k, v in info["header_at"].asDict().items()))
            own = own.where(~(F.col("line").startswith("%") & (F.col("at") < place)))
        wrong = _body(own, info).where(~F.coalesce(good, F.lit(False)))
        shown = [x["line"] for x in wrong.select("line").limit(10).collect()]
        if shown:
            raise ValueError(f"{name}: not an entry of a {nrows} x {ncols} matrix: {shown}")
    if info["stated"] - 1 != nnz:
        raise ValueError(f"{name}: {nnz} entries announced, {info['stated'] - 1} found")
    return nrows, ncols, nnz


def _body(lines: DataFrame, info) -> DataFrame:
    """The entry lines of one matrix: ``matrix_id, line`` for all but the header.

    The header is told by its text, which holds however the file is split on a later
    read.  Only where other lines have three numbers too can an entry repeat that
    text; then the copies are counted and all but one are put back.
    """
    header = info["header"]
    others = lines.select("matrix_id", "line").where(F.col("line") != F.lit(header))
    copies = 1 if info["triples"] == 1 else lines.where(F.col("line") == F.lit(header)).count()
    if copies <= 1:
        return others
    put_back = lines.sparkSession.range(copies - 1)
    return others.union(put_back.select(F.lit(info["matrix_id"]), F.lit(header)))


def _single(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    lines = _lines(spark, path, path)
    found = _survey(lines)
    if not found:
        raise ValueError(f"{path}: no header line with rows, columns and entries")
    nrows, ncols, _ = _check(found[0], lines)
    return _body(lines.where(~F.col("line").startswith("%")), found[0]), nrows, ncols


def read_mtx_raw(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """Checked entries as stated in the text, repeats included, 0-based, and the shape."""
    body, nrows, ncols = _single(spark, path)
    return body.select((_index(0) - 1).alias(ROW), (_index(1) - 1).alias(COL)), nrows, ncols


#: Scheme and host of a path.
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def read_mtx(spark: SparkSession, path: str, undirected: bool = False) -> Matrix:
    """The pattern of a Matrix Market text: only the first two numbers of a line count.

    ``undirected`` mirrors the entries; the banner of the file is a comment and does
    not decide that.
    """
    raw, nrows, ncols = read_mtx_raw(spark, path)
    if undirected:
        return mirror(Matrix(raw, nrows, ncols))  # its own dedup covers the repeats
    return Matrix(raw.distinct(), nrows, ncols)


def read_mtx_square(spark: SparkSession, path: str) -> Matrix:
    """The square kept next to ``path`` under the name ``<path>2``; never mirrored."""
    return read_mtx(spark, path + "2")


def _banner(spark: SparkSession, path: str) -> str:
    """The symmetry that the banner of a text states; general without a banner."""
    lines = _lines(spark, path, path).where(F.lower("line").startswith("%%matrixmarket"))
    found = lines.orderBy("at").select(F.lower("line").alias("line")).first()
    if found is None:
        return "general"
    field, kind = (found["line"].split() + [""] * 5)[3:5]
    if field not in ("", "real", "integer", "pattern"):
        raise ValueError(f"{path}: the banner states {field!r} values")
    kind = kind or "general"
    if kind not in ("general", "symmetric", "skew-symmetric"):
        raise ValueError(f"{path}: the banner states {kind!r}")
    return kind


def read_mtx_values(
    spark: SparkSession,
    path: str,
    undirected: bool = False,
    keep_zeros: bool = True,
    dup: str = "sum",
    symmetry: str = "caller",
) -> Matrix:
    """Real values from the third number of each line; a line without one counts as 1.

    Repeats follow ``dup``: sum, max or min.  ``symmetry="caller"`` mirrors as
    ``undirected`` says; with ``"banner"`` the ``%%MatrixMarket`` line of the text
    decides: general, symmetric, or skew-symmetric (the mirror image is negated).
    """
    if symmetry not in ("caller", "banner"):
        raise ValueError(f"symmetry is caller or banner, not {symmetry!r}")
    kind = _banner(spark, path) if symmetry == "banner" else ("symmetric" if undirected else "general")
    body, nrows, ncols = _single(spark, path)
    value = F.coalesce(_token(2).cast("double"), F.lit(1.0))
    entries = body.select((_index(0) - 1).alias(ROW), (_index(1) - 1).alias(COL), value.alias(VAL))
    if not keep_zeros:
        entries = entries.where(F.col(VAL) != 0)
    if kind == "skew-symmetric":
        if nrows != ncols:
            raise ValueError(f"{path}: only a square matrix can be mirrored")
        image = entries.where(F.col(ROW) != F.col(COL))
        image = image.select(F.col(COL).alias(ROW), F.col(ROW).alias(COL), (-F.col(VAL)).alias(VAL))
        entries = entries.union(image)
    A = Matrix.from_edges(entries, ROW, COL, nrows, ncols, VAL, dup, check=False)
    return mirror(A) if kind == "symmetric" else A


def write_mtx(A: Matrix, path: str) -> int:
    """Write the pattern as Matrix Market text below ``path``; returns the entry count.

    The entries are written in parallel and counted on the way, then the header
    goes to a part that sorts first.
    """
    spark = A.df.sparkSession
    counted = Observation()
    lines = A.extract_pairs().distinct().select(F.concat_ws(" ", F.col(ROW) + 1, F.col(COL) + 1).alias("value"))
    lines = lines.observe(counted, F.count(F.lit(1)).alias("n"))
    lines.write.mode("overwrite").text(f"{path}/{_BODY_PART}")
    nnz = counted.get["n"]
    header = spark.range(1).select(F.lit(f"{A.nrows} {A.ncols} {nnz}").alias("value"))
    header.write.mode("overwrite").text(f"{path}/{_HEADER_PART}")
    return nnz


def write_mtx_values(A: Matrix, path: str) -> int:
    """Like :func:`write_mtx` with the value as third number."""
    spark = A.df.sparkSession
    counted = Observation()
    # A number of its own for each part: a missing value fails the query instead of leaving a shorter line.
    missing = F.raise_error(F.concat_ws(" ", F.lit("no value at"), F.col(ROW), F.col(COL)))
    value = F.when(F.col(VAL).isNotNull(), F.col(VAL).cast("string")).otherwise(missing)
    text = F.concat_ws(" ", F.col(ROW) + 1, F.col(COL) + 1, value)
    lines = A.df.select(text.alias("value")).observe(counted, F.count(F.lit(1)).alias("n"))
    lines.write.mode("overwrite").text(f"{path}/{_BODY_PART}")
    nnz = counted.get["n"]
    header = spark.range(1).select(F.lit(f"{A.nrows} {A.ncols} {nnz}").alias("value"))
    header.write.mode("overwrite").text(f"{path}/{_HEADER_PART}")
    return nnz


def _owners(spark: SparkSession, entries: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """``__file, matrix_id``: the texts that each file belongs to, those whose path it is or lies below.

    The files are a table of their own (paths alone, no content is read) that meets
    the list on the paths of its folders.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def place(path: str) -> str:
        found = hadoop(path)
        return found.getFileSystem(conf).makeQualified(found).toUri().getPath()

    listed = spark.createDataFrame([(place(path), name) for name, path, _ in entries], "__path string, matrix_id string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(sorted({path for _, path, _ in entries}))
    parts = F.split(F.regexp_replace("path", _SCHEME, ""), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    placed = files.select(F.col("_metadata.file_path").alias("__file"), F.explode(above).alias("__path"))
    owned = materialize(placed.join(F.broadcast(listed), "__path").select("__file", "matrix_id"))  # the list is the caller's
    return F.broadcast(owned) if owned.count() <= BROADCAST_KEYS else owned


def _named_lines(spark: SparkSession, entries: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """The lines of several texts from one scan, as :func:`_lines` gives them for one."""
    raw = spark.read.option("recursiveFileLookup", "true").text(sorted({path for _, path, _ in entries}))
    at = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    lines = raw.select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("line"), at.alias("at"))
    met = lines.where(F.col("line") != "").join(_owners(spark, entries), F.col("at.file") == F.col("__file"))
    return met.select("matrix_id", "line", "at")


def read_many(spark: SparkSession, entries: Sequence[tuple[str, str, bool]]) -> tuple[DataFrame, DataFrame]:
    """Several matrices as one table.

    ``entries`` lists (matrix_id, path, undirected).  Returns the distinct positions
    ``matrix_id, row_id, col_id`` and the shapes ``matrix_id, nrows, ncols``.  All
    texts are one scan, surveyed by one aggregation; the number of jobs does not
    depend on the number of texts.
    """
    if not entries:
        raise ValueError("the workload is empty")
    lines = _named_lines(spark, entries)
    infos = {x["matrix_id"]: x for x in _survey(lines)}
    missing = [name for name, _, _ in entries if name not in infos]
    if missing:
        raise ValueError(f"no header line in {missing}")
    shapes, heads = [], []
    for name, _, undirected in entries:
        nrows, ncols, _ = _check(infos[name], lines)
        if undirected and nrows != ncols:
            raise ValueError(f"{name}: only a square matrix can be mirrored")
        shapes.append((name, nrows, ncols))
        heads.append((name, infos[name]["header"], bool(undirected)))
    known = spark.createDataFrame(heads, "matrix_id string, __header string, __both boolean")
    stated = lines.where(~F.col("line").startswith("%")).join(known, "matrix_id")
    body = stated.where(F.col("line") != F.col("__header")).select("matrix_id", "line", "__both")
    doubtful = [name for name, _, _ in entries if infos[name]["triples"] > 1]
    if doubtful:
        # Entries of three numbers may repeat the header's text: all copies but one are entries.
        same = stated.where(F.col("matrix_id").isin(doubtful) & (F.col("line") == F.col("__header")))
        copies = same.groupBy("matrix_id", "line", "__both").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
        again = F.explode(F.sequence(F.lit(2).cast("long"), F.col("__n")))
        body = body.union(copies.withColumn("__again", again).select("matrix_id", "line", "__both"))
    pairs = body.select("matrix_id", "__both", (_index(0) - 1).alias(ROW), (_index(1) - 1).alias(COL))
    here, there = F.struct(ROW, COL), F.struct(F.col(COL).alias(ROW), F.col(ROW).alias(COL))
    images = F.when(F.col("__both"), F.array(here, there)).otherwise(F.array(here))
    table = pairs.select("matrix_id", F.explode(images).alias("__e")).select("matrix_id", "__e.*").distinct()
    return table, spark.createDataFrame(shapes, "matrix_id string, nrows bigint, ncols bigint")
