"""Mixing sources to target weights by iterative proportional fitting.  DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Stands for a missing source, language or topic.
MISSING = "(none)"
#: Topic of a text that no cue matches.
GENERAL = "general"
#: Cues of the topics in the order in which they are tried (fixed values).
TOPIC_CUES = (
    ("legal", r"(?i)licen[sc]e|copyright|warrant"),
    ("contact", r"[\w.+-]+@[\w-]+\.\w+|https?://"),
    ("tables", r"\|[^\n|]*\|[^\n|]*\|"),
)
DIMENSIONS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Targets:
    """Share of tokens that each value of a dimension should get.

    A dimension without shares gets equal ones for all its values.  Shares of values that the
    data lack are dealt over the others in proportion; values without a share, where others
    have one, get ``rest`` in equal parts.  ``fraction`` is the share of all tokens to keep.
    """

    shares: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    rest: float = 0.05
    fraction: float = 0.5
    seed: int = 11
    sweeps: int = 40
    tolerance: float = 1e-4


def topic(text: str = "text", cues=TOPIC_CUES) -> Column:
    """First topic whose cue the text holds; a null text has none."""
    out = F.when(F.col(text).isNull(), F.lit(MISSING))
    for name, pattern in cues:
        out = out.when(F.col(text).rlike(pattern), F.lit(name))
    return out.otherwise(F.lit(GENERAL))


def dimensions(
    text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None
) -> list[Column]:
    """``source``, ``lang`` and ``topic`` of a row; the topic by cues unless a column gives it."""
    given = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in (source_col, lang_col)]
    label = topic(text_col) if topic_col is None else F.coalesce(F.col(topic_col).cast("string"), F.lit(MISSING))
    return [c.alias(d) for c, d in zip([*given, label], DIMENSIONS)]


def weighed(
    docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", lang_col="lang", topic_col=None
) -> DataFrame:
    """``doc_id``, ``source``, ``lang``, ``topic`` and ``tokens`` (words, one at least) of each row."""
    text = F.col(text_col)
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        *dimensions(text_col, source_col, lang_col, topic_col),
        F.greatest(F.coalesce(words, F.lit(0)), F.lit(1)).cast("long").alias("tokens"),
    )


def _goals(cells: DataFrame, dimension: str, targets: Targets) -> DataFrame:
    """``value`` and ``goal`` of one dimension: the targets over the values that occur."""
    values = cells.groupBy(F.col(dimension).alias("value")).agg(F.lit(1).alias("one"))
    wanted = targets.shares.get(dimension, {})
    if not wanted:
        share = F.lit(1.0)
    else:
        listed = F.create_map(*[F.lit(x) for pair in sorted(wanted.items()) for x in pair])
        share = F.try_element_at(listed, F.col("value"))
    named = values.select("value", share.cast("double").alias("share"))
    sums = named.agg(
        F.coalesce(F.sum("share"), F.lit(0.0)).alias("listed"),
        F.count(F.when(F.col("share").isNull(), 1)).alias("others"),
    )
    rest = F.when(F.col("others") == 0, 0.0).when(F.col("listed") == 0, 1.0).otherwise(targets.rest)
    return named.join(F.broadcast(sums)).select(  # one row of sums
        "value",
        F.when(F.col("share").isNull(), rest / F.col("others"))
        .otherwise((1 - rest) * F.col("share") / F.col("listed"))
        .alias("goal"),
    )


def _scaled(dimension: str) -> Column:
    """The weight that meets the goal of ``dimension``, cut at what the cell has."""
    scaled = F.col("weight") * F.col(f"goal_{dimension}") / F.col("sum")
    return F.least(F.coalesce(scaled, F.lit(0.0)), F.col("tokens").cast("double"))


def _sweep_joined(now: DataFrame, names: list[str]) -> DataFrame:
    """One sweep over cells in many partitions; ``moved`` is the change of the cell's own weight."""
    swept = now.withColumn("old", F.col("weight"))
    for dimension in DIMENSIONS:
        sums = swept.groupBy(dimension).agg(F.sum("weight").alias("sum"))
        swept = swept.join(sums.hint("shuffle_hash"), dimension).select(
            *names, "old", _scaled(dimension).alias("weight")
        )
    moved = F.abs(F.col("weight") - F.col("old")) / F.col("all")
    return swept.select(*names, "weight", moved.alias("moved"))


def _sweep_in_place(now: DataFrame, names: list[str], tolerance: float) -> DataFrame:
    """One sweep over cells in one partition; ``moved`` is the largest change of all.

    Has no exchange and reads each cell once, so several sweeps fit one job.  Once ``moved`` is
    within the tolerance the weights stay as they are.
    """
    settled = F.col("settled")
    swept = now.select(*names, "weight", F.col("weight").alias("old"), (F.col("moved") <= tolerance).alias("settled"))
    for dimension in DIMENSIONS:
        total = F.sum("weight").over(Window.partitionBy(dimension))
        swept = swept.withColumn("sum", total).select(
            *names, "old", "settled", F.when(settled, F.col("weight")).otherwise(_scaled(dimension)).alias("weight")
        )
    moved = F.max(F.abs(F.col("weight") - F.col("old")) / F.col("all")).over(Window.partitionBy())
    return swept.select(*names, "weight", moved.alias("moved"))


def rake(
    cells: DataFrame, targets: Targets = Targets(), cells_per_task: int = 100_000, sweeps_per_job: int = 5
) -> DataFrame:
    """``cells`` with ``weight``: the tokens to take from each cell.

    ``cells`` has a row for each source, language and topic that occur together, with its
    ``tokens``.  Starting from the tokens, each sweep scales the weights so that one dimension
    after the other meets its targets, and cuts what a cell does not have.  Ends when no
    weight moves by more than ``tolerance`` of all tokens, or after ``sweeps``; then
    ``gap`` says by how much the cell's source is off its target, as a share.  Where a value has
    too few tokens its target can't be met: it is taken whole.
    A cell is an aggregate, so the work here does not grow with the documents of a cell.

    Every job costs the driver plans, stages and task states, so up to ``cells_per_task`` cells
    take ``sweeps_per_job`` sweeps a job in one partition; more cells are dealt out, a sweep a job.
    """
    parts = cells.count() // cells_per_task + 1
    if parts == 1:
        cells = cells.coalesce(1)
    total = cells.agg(F.sum("tokens").cast("double").alias("all"))
    now = cells.join(F.broadcast(total)).withColumn(  # one row
        "weight", F.col("tokens") * F.lit(targets.fraction)
    )
    for dimension in DIMENSIONS:
        goal = _goals(cells, dimension, targets)
        now = (
            now.join(goal.withColumnRenamed("value", dimension), dimension)
            .withColumn(f"goal_{dimension}", F.col("goal") * F.col("all") * F.lit(targets.fraction))
            .drop("goal")
        )

    def settle(df: DataFrame) -> DataFrame:
        return staged(df.coalesce(parts)).coalesce(parts)

    names = [n for n in now.columns if n != "weight"]
    now = settle(now.withColumn("moved", F.lit(None).cast("double")))
    done = 0
    while done < targets.sweeps:
        if parts == 1:
            sweeps = min(sweeps_per_job, targets.sweeps - done)
            for _ in range(sweeps):
                now = _sweep_in_place(now, names, targets.tolerance)
        else:
            sweeps = 1
            now = _sweep_joined(now, names)
        now = settle(now)
        done += sweeps
        moved = now.agg(F.max("moved")).first()[0]
        if moved is None or moved <= targets.tolerance:
            break
    got = now.groupBy("source").agg(F.sum("weight").alias("got"))
    return now.join(got, "source").select(
        *DIMENSIONS,
        "tokens",
        *[c for c in cells.columns if c not in (*DIMENSIONS, "tokens")],
        "weight",
        (F.abs(F.col("got") - F.col("goal_source")) / F.col("all")).alias("gap"),
    )


def unit(id_col: str = "doc_id", seed: int = 11) -> Column:
    """A number in [0, 1) that depends on the id and the seed only (null: as the text '')."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(2.0**48)


def mix(
    docs: DataFrame,
    targets: Targets = Targets(),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    broadcast_cells: int = 10_000,
    topic_col: str | None = None,
) -> DataFrame:
    """One row per document: ``doc_id``, ``source``, ``lang``, ``topic``, ``tokens``,
    ``probability`` and ``kept``.

    The probability is the cell's raked weight over its tokens, so the tokens kept of a cell are
    its weight on average; a document is kept if its ``unit`` number is below it.  Null
    source or language is a value of its own, a null text has one token and no topic, rows
    that repeat an id are kept or left together.  An empty table gives an empty result.
    The topic is the first cue that the text holds, or ``topic_col`` where a label is at hand.
    Cells are joined by broadcast only after a count shows at most ``broadcast_cells``.
    """
    rows = staged(weighed(docs, id_col, text_col, source_col, lang_col, topic_col))
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    raked = staged(rake(staged(cells), targets))
    chances = raked.select(*DIMENSIONS, F.least(F.lit(1.0), F.col("weight") / F.col("tokens")).alias("probability"))
    if raked.limit(broadcast_cells + 1).count() <= broadcast_cells:
        chances = F.broadcast(chances)
    return rows.join(chances, list(DIMENSIONS)).select(
        "doc_id",
        *DIMENSIONS,
        "tokens",
        "probability",
        (unit("doc_id", targets.seed) < F.col("probability")).alias("kept"),
    )


def sample_mix(docs: DataFrame, targets: Targets = Targets(), **columns) -> DataFrame:
    """The documents that :func:`mix` keeps, with all columns as they were.

    Takes the decision in the scan (cell of the row, chance of the cell), so documents are not
    joined back by id.
    """
    how = {"id_col": "doc_id", "text_col": "text", "source_col": "source", "lang_col": "lang"} | columns
    limit = how.pop("broadcast_cells", 10_000)
    cells = (
        weighed(docs, **how)
        .groupBy(*DIMENSIONS)
        .agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    )
    raked = staged(rake(staged(cells), targets))
    chances = raked.select(
        *DIMENSIONS, F.least(F.lit(1.0), F.col("weight") / F.col("tokens")).alias("chance")
    )
    if raked.limit(limit + 1).count() <= limit:
        chances = F.broadcast(chances)
    # One struct holds the caller's columns, so none of their names can clash.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    cell = {k: v for k, v in how.items() if k != "id_col"}
    marked = docs.select(row, *dimensions(**cell), unit(how["id_col"], targets.seed).alias("unit"))
    return marked.join(chances, list(DIMENSIONS)).where("unit < chance").select("row.*")
