"""Default-branch history: which commits are on it, in what order, what follows what."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_folder, materialise, new_folder, settled, stored

KEY = ["application_name", "commit_id"]

# Commits that a task holds at a time while it contracts a history.
CELL_ROWS = 1 << 18


def first_parents(commits: DataFrame) -> DataFrame:
    """A row per commit: application, commit, first parent (or null), time, head flag.

    A commit listed several times is one: the least of its first parents, the least of its
    times, and a head if any of its rows says so.
    """
    links = commits.select(*KEY, F.get("parents", F.lit(0)).alias("parent"), "commit_time", "is_head")
    return links.groupBy(*KEY).agg(
        F.min("parent").alias("parent"),
        F.min("commit_time").alias("commit_time"),
        F.max(F.coalesce("is_head", F.lit(False))).alias("is_head"),
    )


def _celled(commits: DataFrame, cell_rows: int) -> DataFrame:
    """First parents dealt to ``slice``s: the spans of time of an application.

    An application has one span per ``cell_rows`` of its rows, so one that fits a cell is
    whole, and a larger one is cut where few first parents cross if its times rise.
    """
    ends = commits.groupBy(F.col("application_name").alias("application")).agg(
        F.count(F.lit(1)).alias("n"), F.min("commit_time").alias("oldest"), F.max("commit_time").alias("newest")
    )
    length = F.expr("CAST(newest AS DOUBLE) - oldest + 1")
    spans = F.expr(f"(n + {cell_rows - 1}) div {cell_rows}")
    span = F.floor((F.col("commit_time").cast("double") - F.col("oldest")) / length * spans)
    dealt = first_parents(commits).join(ends, F.col("application_name").eqNullSafe(F.col("application")))
    return dealt.withColumn("slice", F.coalesce(span, F.lit(0)).cast("long")).drop("application", "n", "oldest", "newest")


def _per_cell(rows: DataFrame, names: list[str], order: list[str], schema: str, compute: Callable, cell_rows: int) -> DataFrame:
    """``compute(table, number)`` over runs of rows that agree in the columns ``names``.

    A run longer than ``cell_rows`` is cut, so no more than a cell is held at a time. The
    number of a run is that of its first row; no two rows share a number.
    """
    width = len(names)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            changes = np.zeros(batch.num_rows - 1, bool)
            for k in range(width):
                changes |= np.diff(batch.column(k).dictionary_encode("encode").indices.to_numpy()) != 0
            bounds = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
            for first, end in zip(bounds[:-1], bounds[1:]):
                name = [batch.column(k)[first].as_py() for k in range(width)]
                while first < end:
                    if held and (name != last or size >= cell_rows):
                        yield from compute(pa.Table.from_batches(held), number).to_batches()
                        held, size, number = [], 0, number + size
                    part = batch.slice(first, min(end - first, cell_rows - size))
                    held.append(part)
                    size, last, first = size + part.num_rows, name, first + part.num_rows
        if held:
            yield from compute(pa.Table.from_batches(held), number).to_batches()

    rest = [c for c in rows.columns if c not in names]
    ordered = rows.select(*names, *rest).repartition(*names).sortWithinPartitions(*names, *order)
    return ordered.mapInArrow(run, schema)


_CELL = (
    "application_name string, commit_id string, parent string, commit_time long, is_head boolean, "
    "root long, depth long, marked boolean, cell long"
)


def _contracted(commits: DataFrame, cell_rows: int) -> DataFrame:
    """First parents with each commit's ``root``, ``depth``, ``marked`` and ``cell``.

    The root is the oldest commit that first parents lead to within the commit's cell, by its
    row's number, and the depth is the way there. Marked are heads of the cell and what they lead to in it.
    Commits that lead into a circle are roots, each its own.
    """
    names = [part.split()[0] for part in _CELL.split(", ")]

    def compute(table, number):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.combine_chunks()
        commit, parent = table.column("commit_id"), table.column("parent")
        n = table.num_rows
        at = pc.index_in(parent, value_set=commit.combine_chunks(), skip_nulls=True)
        at = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        if table.column("application_name")[0].as_py() is None:
            at[:] = -1  # no application, no history
        own = np.arange(n)
        up, depth = np.where(at < 0, own, at), (at >= 0).astype(np.int64)
        marked = table.column("is_head").to_numpy()
        for _ in range(n.bit_length() + 1):
            marked = marked.copy()
            marked[up[marked]] = True
            depth = depth + depth[up]
            further = up[up]
            if np.array_equal(further, up):
                break
            up = further
        circle = at[up] >= 0
        up, depth = np.where(circle, own, up), np.where(circle, 0, depth)
        columns = [table.column(name) for name in names[:5]]
        columns += [pa.array(x) for x in (number + up, depth, marked, np.full(n, number, np.int64))]
        return pa.Table.from_arrays([pc.cast(c, t) for c, t in zip(columns, kinds)], names=names)

    import pyarrow as pa

    kinds = [pa.string()] * 3 + [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
    rows = _celled(commits, cell_rows)
    return _per_cell(rows, ["application_name", "slice"], ["commit_time", "commit_id"], _CELL, compute, cell_rows)


_NUMBERED = "application_name string, commit_id string, parent string, commit_time long, seq long"


def _numbered(rows: DataFrame, cell_rows: int) -> DataFrame:
    """Marked commits and those at or before an entry of their cell, with their number.

    ``rows`` has whole cells and the number of each root as ``base``. ``entered`` names the
    commits at which a younger cell goes on.
    """
    names = [part.split()[0] for part in _NUMBERED.split(", ")]

    def compute(table, number):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.combine_chunks()
        commit, parent = table.column("commit_id"), table.column("parent")
        depth = table.column("depth").to_numpy()
        own = np.arange(table.num_rows)
        at = pc.fill_null(pc.index_in(parent, value_set=commit.combine_chunks(), skip_nulls=True), -1)
        up = np.where(depth > 0, at.to_numpy().astype(np.int64), own)
        marked = table.column("entered").to_numpy()
        for _ in range(int(depth.max()).bit_length()):
            marked = marked.copy()
            marked[up[marked]] = True
            up = up[up]
        seq = table.column("base").to_numpy() + depth
        kept = pa.array(marked | table.column("marked").to_numpy())
        columns = [*(table.column(name) for name in names[:4]), pa.chunked_array([pa.array(seq)])]
        return pa.Table.from_arrays([c.filter(kept) for c in columns], names=names)

    return _per_cell(rows, ["cell"], ["commit_id"], _NUMBERED, compute, cell_rows)


def _doubled(tree: DataFrame) -> DataFrame:
    """Each node's reach doubled, and the marks carried over the reach it had before.

    ``at`` is the ancestor so many nodes back, ``steps`` first parents away; ``open`` says
    that there are more. A mark passes to that ancestor. Bit by bit, from the lowest, a mark
    so reaches every ancestor: any distance is a sum of reaches that the nodes on the way have.
    """
    reached = tree.filter("marked AND open").select(F.col("at").alias("node")).distinct()
    reached = reached.withColumn("reached", F.lit(True))
    further = tree.select(
        F.col("node").alias("at"),
        F.col("at").alias("further"),
        F.col("steps").alias("more"),
        F.col("open").alias("onward"),
    )
    # Nodes at the end of their chain stay as they are: they all share a few roots.
    longer = tree.filter("open").join(further, "at").select(
        "node", F.col("further").alias("at"), (F.col("steps") + F.col("more")).alias("steps"),
        F.col("onward").alias("open"), "marked",
    )
    both = tree.filter("NOT open").select("node", "at", "steps", "open", "marked").unionByName(longer)
    return both.join(reached, "node", "left").select(
        "node", "at", "steps", "open", (F.col("marked") | F.coalesce("reached", F.lit(False))).alias("marked")
    )


def branch(commits: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Commits of the default branch: ``parent``, ``commit_time`` and ``seq``, from 0, oldest first.

    The branch is what first parents lead to from the heads. A commit's number is its
    distance from the oldest commit of its chain, so it is the same from whatever head it
    is reached, and each commit comes once; with several heads, commits of different
    chains may share a number. A parent outside the table ends a chain.

    List ranking by contraction. Applications are cut into cells of at most ``cell_rows``
    commits by time, and each cell is reduced to the commits whose first parent lies outside
    it. Only these nodes take part in pointer doubling by joins, log2 rounds of the cells that
    a chain crosses; their numbers and marks are then spread back over the cells. Work is
    linear in the commits but for the nodes. The order of times decides how few nodes there
    are, never the result: branches may interleave, and where no time rises along a chain,
    all commits of an application beyond one cell are nodes.
    """
    spark = commits.sparkSession
    cells = materialise(_contracted(commits, cell_rows), "cells")
    # A node goes by the number of its row: ids are long, and travel in every round.
    roots = cells.filter("depth = 0").select(F.col("root").alias("node"), "application_name", "parent")
    known = cells.select(
        "application_name", F.col("commit_id").alias("parent"), F.col("root").alias("at"),
        (F.col("depth") + 1).alias("steps"), "cell",
    )
    beyond = roots.filter("parent IS NOT NULL").join(known, ["application_name", "parent"])
    crossed = materialise(beyond.select("node", "application_name", "parent", "at", "steps", "cell"), "crossings")
    if crossed.isEmpty():
        # No chain leaves its cell: there is nothing to rank, and the marks are complete.
        return cells.filter("marked").select(*KEY, "parent", "commit_time", F.col("depth").alias("seq"))
    headed = cells.filter("is_head").select(F.col("root").alias("node")).distinct().withColumn("headed", F.lit(True))
    state = roots.select("node").join(crossed.select("node", "at", "steps"), "node", "left").join(headed, "node", "left")
    state = state.select(
        "node", F.coalesce("at", "node").alias("at"), F.coalesce("steps", F.lit(0).cast("long")).alias("steps"),
        F.col("at").isNotNull().alias("open"), F.col("headed").isNotNull().alias("marked"),
    )
    folder = new_folder(spark, "branch")
    state = stored(state, folder)
    limit, reach = None, 1
    while not state.filter("open").isEmpty():
        limit = limit or state.count()
        if reach > 4 * limit:
            raise ValueError("the first-parent chain of a commit leads back to itself")
        before, folder, reach = folder, new_folder(spark, "branch"), reach * 2
        state = stored(_doubled(state), folder)
        drop_folder(spark, before)
    on_branch = state.filter("marked")
    based = cells.join(on_branch.select(F.col("node").alias("root"), F.col("steps").alias("base")), "root")
    # Where the chain of a marked node goes on in an older cell. Only such cells are read
    # again as a whole; in all others the marks within the cell are complete.
    entries = crossed.join(on_branch.select("node"), "node", "left_semi")
    entered = entries.select("cell", "application_name", F.col("parent").alias("commit_id")).distinct()
    touched = entered.select("cell").distinct()
    complete = based.join(touched, "cell", "left_anti").filter("marked")
    reopened = based.join(touched, "cell", "left_semi").join(
        entered.withColumn("entered", F.lit(True)), ["cell", *KEY], "left"
    )
    reopened = reopened.withColumn("entered", F.col("entered").isNotNull()).drop("is_head", "root")
    seq = (F.col("base") + F.col("depth")).alias("seq")
    return complete.select(*KEY, "parent", "commit_time", seq).unionByName(_numbered(reopened, cell_rows))


def first_parent_sequence(commits: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Commits of the default branch numbered from 0, oldest first; see :func:`branch`."""
    return branch(commits, cell_rows).select(*KEY, "seq")


def mainline(commits: DataFrame) -> DataFrame:
    """Commits on the default branch, with all their columns. The branch is stored first."""
    named = settled(commits.sparkSession, "mainline", lambda: first_parent_sequence(commits).select(*KEY))
    return commits.join(named, KEY, "left_semi")


def branch_links(commits: DataFrame) -> DataFrame:
    """The branch's commits, each once, with what :func:`next_commit` needs of them."""
    return branch(commits).select(
        *KEY, F.array_compact(F.array("parent")).alias("parents"), "commit_time"
    )


def next_commit(branch_commits: DataFrame) -> DataFrame:
    """For each commit with a successor on the branch: the successor and its time.

    On the branch a commit's successor is the one commit whose first parent it is. The
    parent link gives the answer without an ordering, so no window over an application.
    """
    return branch_commits.filter(F.size("parents") > 0).select(
        "application_name",
        F.get("parents", F.lit(0)).alias("commit_id"),
        F.col("commit_id").alias("fixing_commit"),
        F.timestamp_seconds("commit_time").alias("fix_date"),
    )
