"""Coverage profiles: text lines to blocks, blocks to lines and rates, and the two reports made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atelier.operators.stretches import ROWS, Stretches

#: ``file:line.column,line.column statements count``
LINE = r"^(.+):([0-9]+)\.[0-9]+,([0-9]+)\.[0-9]+\s+(-?[0-9]+)\s+(-?[0-9]+)$"


def read_profiles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of profiles: profile (file), text. A folder or several files may be given."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("profile"), F.col("value").alias("text"))


def parsed(lines: DataFrame) -> DataFrame:
    """Lines with a block: profile, pos, file, first, last, statements, count, problem (null where the line can be read).

    Empty lines and ``mode:`` lines are left out. A block that ends before it begins is its first line.
    """
    line = F.trim(F.regexp_replace("text", r"\s+", " "))
    number = lambda k: F.regexp_extract(line, LINE, k).try_cast("long")
    bad = ~line.rlike(LINE) | number(2).isNull() | number(3).isNull() | number(4).isNull() | number(5).isNull()
    rows = lines.select("profile", line.alias("_line"), "text").where((F.col("_line") != "") & ~F.startswith("_line", F.lit("mode:")))
    line = F.col("_line")
    first = number(2)
    return rows.select(
        "profile", F.substring_index("_line", " ", 1).alias("pos"), F.regexp_extract(line, LINE, 1).alias("file"), first.alias("first"),
        F.greatest(first, number(3)).alias("last"), number(4).alias("statements"), number(5).alias("count"),
        F.when(bad, F.concat(F.lit('malformed profile line "'), "text", F.lit('"'))).alias("problem"),
    )


def blocks(lines: DataFrame) -> DataFrame:
    """Blocks of all profiles; a line that can't be read ends the job with its text."""
    rows = parsed(lines)
    checked = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat("profile", F.lit(": "), "problem")).cast("string")).otherwise(F.col("pos"))
    return rows.select("profile", checked.alias("pos"), "file", "first", "last", "statements", "count")


def merged(rows: DataFrame) -> DataFrame:
    """One block a position: the highest count, of equal ones the most statements."""
    best = F.max_by(F.struct("file", "first", "last", "statements", "count"), F.struct("count", "statements")).alias("b")
    return rows.groupBy("pos").agg(best).select("pos", "b.*")


def located(rows: DataFrame, strip: str = "") -> DataFrame:
    """Adds the package of each block and cuts a prefix off its file: the package is the folder with ``_`` for ``/``, or ``.``."""
    file = F.when(F.startswith("file", F.lit(strip)), F.substr("file", F.lit(len(strip) + 1))).otherwise(F.col("file"))
    folder = F.regexp_extract(file, r"(?s)^(.*)/", 1)
    package = F.when(folder == "", ".").otherwise(F.translate(folder, "/\\", "__"))
    return rows.withColumns({"package": package, "file": file})


def line_hits(rows: DataFrame, strip: str = "") -> DataFrame:
    """Hits of every line that a block covers, the highest of them: package, file, line, hits.

    A line's maximum is combined before the shuffle, so blocks that overlap a thousandfold cost little.
    For sums over lines ``swept`` needs no line of its own.
    """
    each = located(rows, strip).select("package", "file", F.explode(F.sequence("first", "last")).alias("line"), "count")
    return each.groupBy("package", "file", "line").agg(F.max("count").alias("hits"))


def swept(rows: DataFrame, strip: str = "", stretch: int = ROWS) -> DataFrame:
    """Valid and covered lines of every file, by a sweep over its blocks: package, file, valid, covered.

    Blocks are taken by their first lines; each adds the lines beyond the furthest that blocks before it
    have reached, and if it was hit, those beyond the furthest of hit blocks to the covered lines. So a block
    costs one row however many lines it has, and a file of very many blocks is cut into stretches.
    """
    cut = Stretches(located(rows, strip).select("package", "file", "first", "last", "count"), ["package", "file"], ["first", "last", "count"], stretch)
    hit = F.when(F.col("count") > 0, F.col("last"))
    reached = cut.before(cut.rows, F.col("last"), "_reached", F.max, F.greatest)
    reached = cut.before(reached, hit, "_hit", F.max, F.greatest)
    added = lambda end, furthest: F.greatest(F.lit(0), end - F.greatest(F.col("first") - 1, F.col(furthest)))
    covered = F.when(hit.isNotNull(), added(hit, "_hit")).otherwise(0)
    return reached.groupBy("package", "file").agg(F.sum(added(F.col("last"), "_reached")).alias("valid"), F.sum(covered).alias("covered"))


def rates(lines: DataFrame) -> DataFrame:
    """Valid and covered lines and their rate of every file, package and the whole: package, file (null above), valid, covered, rate."""
    return rolled(lines.groupBy("package", "file").agg(F.count(F.lit(1)).alias("valid"), F.count_if(F.col("hits") > 0).alias("covered")))


def rolled(files: DataFrame) -> DataFrame:
    """The same from valid and covered lines of every file."""
    sums = files.rollup("package", "file").agg(F.sum("valid").alias("valid"), F.sum("covered").alias("covered"))
    return sums.withColumn("rate", F.round(F.col("covered") / F.col("valid"), 4))


def profile_text(rows: DataFrame) -> DataFrame:
    """A merged profile as lines: value, in the order of place and value (the mode comes first)."""
    body = rows.select(F.lit(1).alias("place"), F.concat_ws(" ", "pos", "statements", "count").alias("value"))
    return body.unionByName(rows.sparkSession.createDataFrame([(0, "mode: set")], "place int, value string"))


def _escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def cobertura(lines: DataFrame, source: str = ".") -> DataFrame:
    """A Cobertura report as lines: key (sorting by it gives their order) and value.

    Each line is made where its row is; nothing but the sort brings them together.
    """
    rated = rates(lines)
    rate = lambda: F.format_string("%.4f", F.coalesce("rate", F.lit(0.0)))
    counted = lambda: F.concat(F.lit('line-rate="'), rate(), F.lit('" lines-covered="'), F.col("covered"), F.lit('" lines-valid="'), F.col("valid"), F.lit('" branch-rate="0.0" branches-covered="0" branches-valid="0"'))
    key = lambda *parts: F.array(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    number = F.lpad(F.col("line").cast("string"), 12, "0")
    whole, package = rated.where("package IS NULL"), rated.where("package IS NOT NULL AND file IS NULL")
    file = rated.where("file IS NOT NULL")
    name = F.regexp_extract("file", r"(?s)([^/]*)$", 1)
    row = lambda df, k, *text: df.select(k.alias("key"), F.concat(*[t if isinstance(t, Column) else F.lit(t) for t in text]).alias("value"))
    parts = [
        row(whole, key("0"), '<?xml version="1.0" ?>\n<!DOCTYPE coverage SYSTEM "http://cobertura.sourceforge.net/xml/coverage-04.dtd">\n<coverage ', counted(), ' complexity="0" timestamp="0">\n  <sources>\n    <source>', _escaped(F.lit(source)), "</source>\n  </sources>\n  <packages>"),
        row(package, key("1", F.col("package"), "0"), '    <package name="', _escaped(F.col("package")), '" ', counted(), ">\n      <classes>"),
        row(file, key("1", F.col("package"), "1", F.col("file"), "0"), '        <class name="', _escaped(name), '" filename="', _escaped(F.col("file")), '" ', counted(), ">\n          <lines>"),
        row(lines, key("1", F.col("package"), "1", F.col("file"), "1", number), '            <line number="', F.col("line").cast("string"), '" hits="', F.col("hits").cast("string"), '" branch="false"/>'),
        row(file, key("1", F.col("package"), "1", F.col("file"), "2"), "          </lines>\n        </class>"),
        row(package, key("1", F.col("package"), "2"), "      </classes>\n    </package>"),
        row(whole, key("2"), "  </packages>\n</coverage>"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_text(rows: DataFrame, order: list[str], path: str) -> None:
    """Lines in order as text files, whose names sort in that order."""
    rows.orderBy(*order).select("value").write.text(path)
