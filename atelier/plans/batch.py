"""Folder runs: what each archive is turned into, what is done already, and how the run ended."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atelier.operators import names

VIDEOS, PROJECTS, LAYERED = "mp4", "procreate", "psd"
SUFFIX = "slim"
#: Results of an archive in the order of reports, and the exit code of a run with a failure.
STATUSES, FAILED = ("converted", "existed", "no_video", "failed"), 1


def default_output(folder: str) -> str:
    """Where a run writes if it isn't told: the folder's own name with a suffix, or ``output`` for one without a name."""
    name = posixpath.basename(posixpath.normpath(folder))
    return "output" if name in ("", ".", "..", "/") else f"{name}_{SUFFIX}"


def nesting_problem(folder: str, output: str, recursive: bool) -> str | None:
    """Why results can't be written there: onto the input, or, in a recursive run, below it. Whole path elements are compared."""
    source, target = posixpath.normpath(folder), posixpath.normpath(output)
    if source == target:
        return f"OUTPUT must not be the input directory itself: {output}"
    if recursive and target.startswith(source.rstrip("/") + "/"):
        return f"OUTPUT {output} is inside the input tree {folder}"
    return None


def planned(files: DataFrame, folder: str, output: str, recursive: bool = False, layered: bool = False) -> DataFrame:
    """What every archive produces: path, timelapse, project and, if asked for, layered.

    files: path. Archives are taken in the order of their paths; names that collide in a folder get a
    number. In a recursive run the folders below the input are kept below the output.
    """
    below = F.regexp_extract(F.substr("path", F.lit(len(folder.rstrip("/")) + 2)), r"^(.*)/", 1)
    place = below if recursive else F.lit("")
    named = names.collision_names(files.select("path", place.alias("below")), F.col("below"), names.stem(F.col("path")), "path")
    at = lambda kind, ending: F.concat_ws("/", F.lit(f"{output}/{kind}"), F.when(F.col("below") != "", F.col("below")), F.concat("name", F.lit(ending)))
    out = named.select("path", at(VIDEOS, ".mp4").alias("timelapse"), at(PROJECTS, f".{SUFFIX}.procreate").alias("project"), at(LAYERED, ".psd").alias("layered"))
    return out if layered else out.drop("layered")


def packed_paths(entries: DataFrame, output: str) -> DataFrame:
    """Projects that an earlier run packed: path. entries: name, the members of its archive; folders and strangers don't count."""
    own = F.startswith("name", F.lit(PROJECTS + "/")) & ~F.endswith("name", F.lit("/"))
    return entries.where(own).select(F.concat(F.lit(output + "/"), "name").alias("path")).distinct()


def presence(plan: DataFrame, done: DataFrame) -> DataFrame:
    """How much of each archive's set is there: path, state (none, some, all), only_timelapse_missing. done: path of results."""
    targets = [c for c in plan.columns if c != "path"]
    each = plan.select("path", F.explode(F.array(*[F.struct(F.lit(t).alias("kind"), F.col(t).alias("target")) for t in targets])).alias("t"))
    marked = each.select("path", "t.kind", "t.target").join(done.select(F.col("path").alias("target"), F.lit(True).alias("there")).distinct(), "target", "left")
    there, missing = F.col("there").isNotNull(), F.col("there").isNull()
    counted = marked.groupBy("path").agg(F.count_if(there).alias("n_there"), F.count_if(missing).alias("n_missing"), F.count_if(missing & (F.col("kind") == "timelapse")).alias("n_timelapse"))
    state = F.when(F.col("n_there") == 0, "none").when(F.col("n_missing") == 0, "all").otherwise("some")
    return counted.select("path", state.alias("state"), ((F.col("n_missing") == 1) & (F.col("n_timelapse") == 1) & (F.col("n_there") > 0)).alias("only_timelapse_missing"))


def to_do(plan: DataFrame, done: DataFrame, listing: DataFrame, force: bool = False) -> DataFrame:
    """What a run does with each archive: path, action (skip, convert, regenerate).

    A set that is there is skipped. One of which only the video is missing is skipped too if the archive
    has none; any other part of a set is made anew as a whole. listing: path, n_segments, error.
    """
    rows = presence(plan, done).join(listing.select("path", "n_segments", "error"), "path", "left")
    without = F.col("only_timelapse_missing") & (F.col("n_segments") == 0) & F.col("error").isNull()
    action = F.when(F.lit(force), "convert").when((F.col("state") == "all") | without, "skip").when(F.col("state") == "some", "regenerate").otherwise("convert")
    return rows.select("path", action.alias("action"))


def results(actions: DataFrame, listing: DataFrame, problems: DataFrame) -> DataFrame:
    """How each archive ended: path, status, problem. A failure is a row, not the end of the run.

    problems: path, number, problem of segments that can't be converted or joined; the first by number
    is the archive's, as a conversion stops there.
    """
    first = problems.groupBy("path").agg(F.min_by("problem", "number").alias("segment_problem"))
    rows = actions.join(listing.select("path", "n_segments", "code", "error", F.col("problem").alias("listed")), "path", "left").join(first, "path", "left")
    failed = F.coalesce(F.col("error"), F.when(F.col("code") == 5, F.coalesce("listed", F.lit("segments that can't be used"))), F.when(F.col("n_segments") > 0, F.col("segment_problem")))
    status = F.when(F.col("action") == "skip", "existed").when(failed.isNotNull(), "failed").when(F.col("n_segments") == 0, "no_video").otherwise("converted")
    return rows.select("path", status.alias("status"), F.when(F.col("action") != "skip", failed).alias("problem"))


def counters(ended: DataFrame) -> DataFrame:
    """One row: the number of archives of each status, the exit code, and whether the projects may be packed."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    failed = F.col("failed") > 0
    return ended.agg(*counts).select(*STATUSES, F.when(failed, FAILED).otherwise(0).alias("exit_code"), (~failed).alias("pack"))


def listing_text(listing: DataFrame) -> DataFrame:
    """A line of report an archive: path, report."""
    n = F.col("n_segments")
    some = F.concat(n.cast("string"), F.when(n == 1, " segment, number ").otherwise(" segments, numbers "), F.concat_ws("-", F.col("first").cast("string"), F.when(n > 1, F.col("last").cast("string"))))
    text = F.when(F.col("error").isNotNull(), F.col("error")).when(n > 0, F.concat_ws("; ", some, "problem")).otherwise("no timelapse video inside")
    return listing.select("path", text.alias("report"))


def diagnosed(listing: DataFrame) -> DataFrame:
    """One row: archives that can be used, have no video, or failed, and the exit code; an archive without video is no failure."""
    counts = [F.count_if(F.col("code") == 0).alias("fine"), F.count_if(F.col("code") == 4).alias("no_video"), F.count_if(F.col("code").isin(3, 5)).alias("failed")]
    return listing.agg(*counts).withColumn("exit_code", F.when(F.col("failed") > 0, FAILED).otherwise(0))


def project_files(files: DataFrame, output: str) -> DataFrame:
    """Files below the output's projects, as they are named in the packed archive: path, name; in the order of names."""
    root = f"{output}/{PROJECTS}/"
    return files.where(F.startswith("path", F.lit(root))).select("path", F.substr("path", F.lit(len(output) + 2)).alias("name"))
