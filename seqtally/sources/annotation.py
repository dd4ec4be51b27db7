"""Gene lists, id maps, expression, ontology, groups and localization files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import clean_tissue
from ..operators.annotation import resolve_alias

GENE = "FBgn"


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their file and a position that grows down the file: the start of
    the scanned block and a running id inside it, which is all `last one wins` needs."""
    line = F.struct(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")
    )
    return spark.read.text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("_file"), line.alias("_line")
    )


def _last_wins(df: DataFrame, key: list[str], value: str) -> DataFrame:
    return df.groupBy(*key).agg(F.max_by(value, F.struct("_file", "_line")).alias(value))


def _tabs(line: Column) -> Column:
    return F.split(line, "\t")


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """fbgn: first gene id among a line's tab fields; comments and blanks skipped."""
    line = F.trim("value")
    ids = F.filter(_tabs(line), lambda p: p.startswith(GENE))
    return (
        spark.read.text(path)
        .where((line != "") & ~line.startswith("#"))
        .select(F.get(ids, F.lit(0)).alias("fbgn"))
        .where(F.col("fbgn").isNotNull())
    )


def read_gene_list_symbols(spark: SparkSession, path: str) -> DataFrame:
    """fbgn and symbol: the first field that is no gene or transcript id, else the id."""
    parts = _tabs(F.trim("value"))
    ids = F.filter(parts, lambda p: p.startswith(GENE))
    names = F.filter(parts, lambda p: ~p.startswith(GENE) & ~p.startswith("FBtr"))
    rows = (
        _numbered(spark, path)
        .where(~F.trim("value").startswith("#"))
        .select(
            F.get(ids, F.lit(0)).alias("fbgn"),
            F.coalesce(F.get(names, F.lit(0)), F.get(ids, F.lit(0))).alias("symbol"),
            F.size(parts).alias("_n"),
            "_file",
            "_line",
        )
        .where(F.col("fbgn").isNotNull() & (F.col("_n") >= 2))
    )
    return _last_wins(rows, ["fbgn"], "symbol")


def read_set_folders(spark: SparkSession, folder: str) -> DataFrame:
    """value and set_name: the lines of the set_name=... folders that write_gene_sets makes.

    Where no set was inside the size limits there is no such folder, and there are no rows.
    """
    text = spark.read.text(folder)
    name = F.col("set_name").cast("string") if "set_name" in text.columns else F.lit(None).cast("string")
    return text.withColumn("set_name", name)


def read_gene_sets(
    spark: SparkSession, folder: str, suffix: str = "_fbgn_ids", one_file_per_set: bool = True
) -> DataFrame:
    """set_name and fbgn of every set below a folder.

    Sets are files named <set><suffix>.txt, or, with one_file_per_set off, the set_name=...
    folders that write_gene_sets makes.
    """
    line = F.trim("value")
    ids = F.filter(_tabs(line), lambda p: p.startswith(GENE))
    if one_file_per_set:
        text = spark.read.option("pathGlobFilter", f"*{suffix}.txt").text(folder)
        name = F.regexp_replace(F.col("_metadata.file_name"), f"({suffix})?[.]txt$", "")
    else:
        text = read_set_folders(spark, folder)
        name = F.col("set_name")
    return (
        text.where((line != "") & ~line.startswith("#"))
        .select(name.alias("set_name"), F.get(ids, F.lit(0)).alias("fbgn"))
        .where(F.col("fbgn").isNotNull())
    )


def read_symbol_map(spark: SparkSession, path: str, invert: bool = False) -> DataFrame:
    """fbgn -> symbol, the last line of a key wins; inverted: symbol -> fbgn."""
    p = _tabs(F.trim("value"))
    rows = (
        _numbered(spark, path)
        .where(~F.col("value").startswith("#") & (F.size(p) >= 2))
        .select(F.trim(F.get(p, F.lit(0))).alias("fbgn"), F.trim(F.get(p, F.lit(1))).alias("symbol"), "_file", "_line")
        .where(F.col("fbgn").startswith(GENE))
    )
    if not invert:
        return _last_wins(rows, ["fbgn"], "symbol")
    # a gene keeps its first position when a later line renames it
    latest = rows.groupBy("fbgn").agg(
        F.max_by("symbol", F.struct("_file", "_line")).alias("symbol"),
        F.min(F.struct("_file", "_line")).alias("_p"),
    )
    return latest.groupBy("symbol").agg(F.max_by("fbgn", "_p").alias("fbgn"))


def read_alias_map(spark: SparkSession, path: str, organism: str = "Dmel") -> DataFrame:
    """alias -> fbgn from symbol (three casings), primary and secondary ids; last wins."""
    p = _tabs(F.trim("value"))

    def field(i: int) -> Column:
        return F.trim(F.coalesce(F.get(p, F.lit(i)), F.lit("")))

    symbol = field(0)
    others = F.transform(F.split(field(5), ","), lambda s: F.trim(s))
    aliases = F.concat(F.array(symbol, F.lower(symbol), F.upper(symbol), field(4)), others)
    rows = (
        _numbered(spark, path)
        .where(~F.col("value").startswith("##") & (F.size(p) >= 5))
        .where((field(1) == organism) & field(2).startswith(GENE))
        .select(F.explode(F.array_distinct(aliases)).alias("alias"), field(2).alias("fbgn"), "_file", "_line")
        .where(F.col("alias") != "")
    )
    return _last_wins(rows, ["alias"], "fbgn")


def _find(header: list[str], test) -> int | None:
    return next((i for i, c in enumerate(header) if test(c.lower())), None)


EXPRESSION = "fbgn string, tissue string, rpkm double"


def _header(spark: SparkSession, path: str, accept) -> tuple[str | None, list[str]]:
    """First line the filter accepts, and its tab fields; none in a file without such a line.
    One line, read on the driver."""
    found = spark.read.text(path).where(accept(F.col("value"))).limit(1).collect()
    return (found[0][0], found[0][0].split("\t")) if found else (None, [])


def read_expression_long(spark: SparkSession, path: str) -> DataFrame:
    """fbgn, tissue, rpkm; columns found by header text, the last value of a pair wins.

    A file without a header line has no rows.
    """
    ok = ~F.col("value").startswith("#")
    line, header = _header(spark, path, lambda v: ~v.startswith("#") & v.rlike("(?i)rpkm|FBgn(?![0-9])"))
    if line is None:
        return spark.createDataFrame([], EXPRESSION)
    gene = _find(header, lambda c: "fbgn" in c)
    source = _find(header, lambda c: "source_name" in c)
    value = _find(header, lambda c: "rpkm" in c)
    p = _tabs(F.col("value"))
    tissue = F.coalesce(F.get(p, F.lit(source)), F.lit("unknown")) if source is not None else F.lit("unknown")
    rows = (
        _numbered(spark, path)
        .where(ok & (F.col("value") != line))
        .select(
            F.get(p, F.lit(gene)).alias("fbgn"),
            clean_tissue(tissue).alias("tissue"),
            F.coalesce(F.get(p, F.lit(value)).try_cast("double"), F.lit(0.0)).alias("rpkm"),
            "_file",
            "_line",
        )
        .where(F.col("fbgn").startswith(GENE))
    )
    return _last_wins(rows, ["fbgn", "tissue"], "rpkm")


def read_expression_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Wide matrix to long rows fbgn, tissue, rpkm; numbers that do not parse become 0."""
    # Columns that describe the gene rather than a sample.
    about = ("gene_primary_id", "gene_symbol", "gene_fullname", "gene_type")
    line, header = _header(spark, path, lambda v: ~v.startswith("##") & v.rlike("|".join(about)))
    if line is None:
        return spark.createDataFrame([], EXPRESSION)
    names = [c.lstrip("#") for c in header]
    gene = next((i for i, c in enumerate(names) if c in about and ("primary_id" in c or "fbgn" in c)), 0)
    samples = [(i, header[i]) for i, c in enumerate(names) if c not in about]
    p = _tabs(F.col("value"))
    cells = F.array(
        *[F.struct(F.lit(n).alias("sample"), F.get("p", F.lit(i)).alias("v")) for i, n in samples]
    )
    return (
        spark.read.text(path)
        .where(~F.col("value").startswith("##") & (F.col("value") != line))
        .select(p.alias("p"))
        .select(F.get("p", F.lit(gene)).alias("fbgn"), F.explode(cells).alias("c"))
        .where(F.col("fbgn").startswith(GENE) & F.col("c.v").isNotNull())
        .select(
            "fbgn",
            clean_tissue(F.col("c.sample")).alias("tissue"),
            F.coalesce(F.col("c.v").try_cast("double"), F.lit(0.0)).alias("rpkm"),
        )
    )


def read_go(spark: SparkSession, path: str) -> DataFrame:
    """fbgn, symbol, qualifier, go_id, evidence, aspect; negated rows dropped."""
    p = _tabs(F.trim("value"))
    cols = {"fbgn": 1, "symbol": 2, "qualifier": 3, "go_id": 4, "evidence": 6, "aspect": 8}
    return (
        spark.read.text(path)
        .where(~F.col("value").startswith("!") & (F.size(p) >= 9))
        .select(*[F.get(p, F.lit(i)).alias(n) for n, i in cols.items()])
        .where(~F.upper("qualifier").contains("NOT") & F.col("fbgn").startswith(GENE))
    )


def read_gene_groups(spark: SparkSession, path: str, by_name: bool = False) -> DataFrame:
    """group_name and fbgn by group symbol; by_name also lists each group under its name."""
    p = _tabs(F.col("value"))
    labels = F.array_distinct(F.array(F.get(p, F.lit(1)), F.get(p, F.lit(2)))) if by_name else F.array(F.get(p, F.lit(1)))
    return (
        spark.read.text(path)
        .where(~F.col("value").startswith("#") & (F.size(p) >= 7) & ~F.get(p, F.lit(0)).contains("FB_group"))
        .select(F.explode(labels).alias("group_name"), F.get(p, F.lit(5)).alias("fbgn"))
        .where(F.col("fbgn").startswith(GENE) & (F.col("group_name") != ""))
    )


def read_gene_group_details(spark: SparkSession, path: str) -> DataFrame:
    """Every member with its group's id, symbol and name, the parent group and its own symbol."""
    p = _tabs(F.col("value"))
    fields = ["group_id", "group_symbol", "group_name", "parent_id", "parent_symbol", "fbgn", "member_symbol"]
    return (
        spark.read.text(path)
        .where(~F.col("value").startswith("#") & (F.size(p) >= 7) & ~F.get(p, F.lit(0)).contains("FB_group"))
        .select(*[F.when(F.get(p, F.lit(i)) != "", F.get(p, F.lit(i))).alias(name) for i, name in enumerate(fields)])
        .where(F.col("fbgn").startswith(GENE))
    )


def read_localization(spark: SparkSession, path: str, alias_map: DataFrame | None = None) -> DataFrame:
    """fbgn and lower-case term, distinct; uninformative terms dropped, symbols resolved."""
    raw = spark.read.csv(path, header=True)
    low = {c.lower(): c for c in raw.columns}
    gene = next(low[c] for c in ("gene", "symbol") if c in low)
    term = next(low[c] for c in ("term", "pattern", "localization") if c in low)
    rows = raw.select(F.trim(F.col(gene)).alias("symbol"), F.trim(F.col(term)).alias("term")).where(
        (F.col("symbol") != "")
        & (F.col("term") != "")
        & ~F.lower("term").isin("na", "n/a", "none")
        & ~F.col("term").startswith("Annotated by")
    )
    if alias_map is None:
        clean = F.trim(F.regexp_replace("symbol", "[ \t]*[(][^)]+[)]", ""))
        rows = rows.withColumn("fbgn", clean)
    else:
        rows = resolve_alias(rows, alias_map)
    return rows.select("fbgn", F.lower("term").alias("term")).distinct()
