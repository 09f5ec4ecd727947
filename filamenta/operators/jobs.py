"""The history of jobs as a graph table, followed to the job that made a filament's segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Written

#: Words in a job's name by which its kind is known.
EXTRACTED, PICKED = ("Polish", "Extract"), "Pick"


def input_edges(notes: DataFrame, job: str = "job", note: str = "note") -> DataFrame:
    """(job, input, coordinates, reextract) of jobs' notes: the arguments --i, --coord_list and --reextract_data_star of the last line that has each; null where none has."""
    lines = notes.select(F.col(job).alias("job"), F.reverse(F.split(note, "\n")).alias("_lines"))

    def last(argument: str):
        value = F.transform("_lines", lambda x: F.regexp_extract(x, argument + r'\s+"?\s*([^\s"]+)', 1))
        return F.get(F.filter(value, lambda x: x != ""), F.lit(0))

    return lines.select("job", last("--i").alias("input"), last("--coord_list").alias("coordinates"), last("--reextract_data_star").alias("reextract"))


def traced(jobs: DataFrame, starts: DataFrame, force_pick: bool = False) -> DataFrame:
    """(job, source, found, steps) of each start: the job from which its full filaments come.

    jobs: (job, input, coordinates, reextract) by name. From a start the inputs are
    followed to the first job of a kind in EXTRACTED. With force_pick that job must have
    its coordinates from a picking job; else the way goes on from the job that it was
    re-extracted from, or from its own input. found is false where the inputs end
    before, and source is then the last job reached (null if the start has no input); on
    a ring of jobs source is null. steps counts the jobs on the way, source included.

    Ways are doubled from round to round, so rounds are the logarithm of the longest one.
    """
    written = Written(jobs.sparkSession)
    made = jobs.select("job", "input", "coordinates", "reextract").dropDuplicates(["job"])
    about = made.select(F.col("job").alias("input"), F.col("coordinates").alias("_c"), F.col("reextract").alias("_r"))
    steps = made.select("job", "input").join(about, "input", "left")  # a job and the one before it
    kind = lambda name, words: F.coalesce(F.greatest(*[F.instr(name, w) for w in words], F.lit(0)) > 0, F.lit(False))
    extracted = kind("input", EXTRACTED)
    found = extracted if not force_pick else extracted & kind("_c", (PICKED,))
    again = extracted & F.col("_r").isNotNull() if force_pick else F.lit(False)
    # to: the job to go on from; one step may pass two jobs
    ways = steps.select("job", F.when(again & ~found, F.col("_r")).otherwise(F.col("input")).alias("to"), F.when(F.col("input").isNull(), 0).when(again & ~found, 2).otherwise(1).cast("long").alias("n"), found.alias("found"))
    ways = ways.withColumn("ended", F.col("found") | F.col("to").isNull())
    names = ways.select(F.col("to").alias("job")).where("job is not null").distinct().join(ways.select("job"), "job", "left_anti")  # named as inputs, but not described
    ends = names.select("job", F.lit(None).cast("string").alias("to"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("found"), F.lit(True).alias("ended"))
    ways = written.keep(ways.unionByName(ends))
    rounds = max(1, ways.count().bit_length() + 1)
    for _ in range(rounds):
        if ways.where(~F.col("ended")).isEmpty():
            break
        then = ways.select(F.col("job").alias("to"), F.col("to").alias("_to"), F.col("n").alias("_n"), F.col("found").alias("_found"), F.col("ended").alias("_ended"))
        on = ways.where(~F.col("ended")).join(then, "to").select("job", F.when(F.col("_to").isNull(), F.col("to")).otherwise(F.col("_to")).alias("to"), (F.col("n") + F.col("_n")).alias("n"), F.col("_found").alias("found"), F.col("_ended").alias("ended"))
        after = written.keep(ways.where("ended").unionByName(on))
        written.drop(ways)
        ways = after
    out = starts.select("job").distinct().join(ways, "job", "left")
    source = F.when(F.coalesce("ended", F.lit(True)), F.col("to"))
    result = written.keep(out.select("job", source.alias("source"), F.coalesce("found", F.lit(False)).alias("found"), F.when(source.isNotNull(), F.col("n")).otherwise(0).alias("steps")))
    written.close(result)
    return result
