"""Commands that go with a command: same session, same directory, same tool."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cmdlog_spark.functions.commands import semantic_suggestions
from cmdlog_spark.functions.staging import stage
from cmdlog_spark.functions.text import ascii_lower, first_word
from cmdlog_spark.functions.times import floor_div
from cmdlog_spark.operators.filters import close_in_time, command_differs, command_is
from cmdlog_spark.operators.pairs import WIDE, best_partners, leading_pairs
from cmdlog_spark.schema import WINDOW_SECONDS

SESSION = ["salt", "ppid"]
#: Rows per session and hour up to which pairs of rows are compared directly.
HOT_HOUR_ROWS = 128
#: Commands per directory up to which their pairs are formed directly.
HOT_DIRECTORY_COMMANDS = 128
#: Commands of a directory beyond which it is cut into blocks.
BLOCK_COMMANDS = 100_000
#: Lists of hot groups are broadcast up to this length, joined by key beyond.
MAX_BROADCAST_GROUPS = 10_000
#: Halvings that take an hour down to single seconds.
SECOND_BITS = 12

TOOL_COUNT, SESSION_COUNT, DIRECTORY_COUNT, SUGGESTIONS = 3, 2, 2, 5


def _hour(epoch: Column) -> Column:
    return floor_div(epoch, WINDOW_SECONDS)


def _listed_if_few(groups: DataFrame) -> DataFrame | None:
    """None for no groups, a broadcast list for few, else the groups as they are."""
    listed = groups.limit(MAX_BROADCAST_GROUPS + 1).collect()
    if not listed:
        return None
    if len(listed) > MAX_BROADCAST_GROUPS:
        return groups
    return F.broadcast(groups.sparkSession.createDataFrame(listed, groups.schema))


def _ranked(counts: DataFrame, k: int) -> DataFrame:
    order = [F.desc("co_occurrences"), F.desc("latest"), "cmd"]
    return counts.orderBy(*order).limit(k)


# One base command ----------------------------------------------------------


def session_partners(df: DataFrame, cmd: str, k: int = SESSION_COUNT) -> DataFrame:
    """Commands run within an hour of ``cmd`` in its sessions, by row pairs.

    Pairs are counted, not formed, in one sweep: equal rows collapse in the task that
    reads them, runs of the base command stand in their own hour and the two beside it,
    and running sums over one session and hour say how many of them lie near each row.
    """
    hour = _hour(F.col("epoch"))
    is_base = command_is(cmd)
    whole = F.col("cmd").isNotNull() & F.col("epoch").isNotNull()
    for name in SESSION:
        whole = whole & F.col(name).isNotNull()
    hours = F.when(is_base, F.array(hour - 1, hour, hour + 1)).otherwise(F.array(hour))
    seconds = (
        df.where(whole)
        .select(
            *SESSION,
            F.explode(hours).alias("hour"),
            "epoch",
            F.when(~is_base, F.col("cmd")).alias("cmd"),  # null marks the base
        )
        .groupBy(*SESSION, "hour", "epoch", "cmd")
        .agg(F.count("*").alias("runs"))
    )
    base_runs = F.when(F.col("cmd").isNull(), F.col("runs")).otherwise(0)
    by_time = Window.partitionBy(*SESSION, "hour").orderBy("epoch")
    upto = F.sum(base_runs).over(
        by_time.rangeBetween(Window.unboundedPreceding, WINDOW_SECONDS - 1)
    )
    long_before = F.sum(base_runs).over(
        by_time.rangeBetween(Window.unboundedPreceding, -WINDOW_SECONDS)
    )
    near = F.col("near").cast("decimal(19,0)") * F.col("runs").cast("decimal(19,0)")
    counts = (
        seconds.withColumn("near", upto - F.coalesce(long_before, F.lit(0)))
        .where(F.col("cmd").isNotNull() & (F.col("near") > 0))
        .groupBy("cmd")
        .agg(F.sum(near).cast(WIDE).alias("co_occurrences"), F.max("epoch").alias("latest"))
    )
    return _ranked(counts, k)


def directory_partners(df: DataFrame, cmd: str, k: int = DIRECTORY_COUNT) -> DataFrame:
    """Commands run in the directories of ``cmd``, by row pairs.

    Rows shrink to one per directory and command, which is written: it is read for the
    sizes of directories, too. One with very many commands is cut into blocks by command.
    """
    grouped = (
        df.where(F.col("pwd").isNotNull() & F.col("cmd").isNotNull())
        .groupBy("pwd", "cmd")
        .agg(F.count("*").alias("n"), F.max("epoch").alias("latest"))
    )
    rows = stage(grouped, "directory-commands")
    base = rows.where(command_is(cmd)).select("pwd", F.col("n").alias("runs"))
    blocks = F.ceil(F.count("*") / BLOCK_COMMANDS).cast("int")
    large = rows.groupBy("pwd").agg(blocks.alias("blocks")).where(F.col("blocks") > 1)
    large = _listed_if_few(large)
    on = ["pwd"]
    if large is not None:
        on = ["pwd", "block"]
        number = F.pmod(F.xxhash64("cmd"), F.col("blocks")).cast("int")
        rows = rows.join(large, "pwd", "left").withColumn("block", F.coalesce(number, F.lit(0)))
        every = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
        base = base.join(large, "pwd", "left").select("pwd", "runs", F.explode(every).alias("block"))
    counts = (
        rows.where(command_differs(cmd))
        .join(base, on)
        .groupBy("cmd")
        .agg(
            F.sum(F.col("runs").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)"))
            .cast(WIDE)
            .alias("co_occurrences"),
            F.max("latest").alias("latest"),
        )
    )
    return _ranked(counts, k)


def tool_partners(df: DataFrame, cmd: str, k: int = TOOL_COUNT) -> DataFrame:
    """Newest other commands with the same first word and arguments."""
    words = cmd.split()
    key = ascii_lower(F.lit((words[0] if words else "") + " "))
    return (
        df.where(command_differs(cmd) & ascii_lower(F.col("cmd")).startswith(key))
        .groupBy("cmd")
        .agg(F.max("epoch").alias("latest"))
        .orderBy(F.desc("latest"), "cmd")
        .limit(k)
    )


# Every base command --------------------------------------------------------


def _mirrored(pairs: DataFrame) -> DataFrame:
    """Both directions of unordered pairs ``a, c, n, last_a, last_c``."""

    def side(base: str, cmd: str, latest: str) -> Column:
        return F.struct(
            F.col(base).alias("base"),
            F.col(cmd).alias("cmd"),
            F.col("n").cast(WIDE).alias("n"),
            F.col(latest).alias("latest"),
        )

    return pairs.select(F.inline(F.array(side("a", "c", "last_c"), side("c", "a", "last_a"))))


def _calm_session_pairs(events: DataFrame) -> DataFrame:
    """Pair counts by comparing rows of one session and hour.

    Each row looks into its own hour and the next, the earlier row of a pair
    finding the later one, so every pair is met once.
    """
    hour = _hour(F.col("epoch"))
    early = events.select(
        *SESSION,
        F.explode(F.array(hour, hour + 1)).alias("hour"),
        F.col("epoch").alias("at_a"),
        F.col("cmd").alias("a"),
    )
    late = events.select(
        *SESSION, hour.alias("hour"), F.col("epoch").alias("at_c"), F.col("cmd").alias("c")
    )
    a_first = (F.col("at_a") < F.col("at_c")) | (
        (F.col("at_a") == F.col("at_c")) & (F.col("a") < F.col("c"))
    )
    met = early.join(late, [*SESSION, "hour"]).where(
        a_first & (F.col("a") != F.col("c")) & close_in_time(F.col("at_a"), F.col("at_c"))
    )
    counted = met.groupBy("a", "c").agg(
        F.count("*").alias("n"), F.max("at_a").alias("last_a"), F.max("at_c").alias("last_c")
    )
    return _mirrored(counted)


def _session_cells(events: DataFrame) -> DataFrame:
    """Cells of sessions too busy to compare row by row.

    Two rows of one hour are always close. A row in an hour and one in the
    next are close when the second of the hour of the later row is the smaller
    one; numbers compare by their highest differing bit, so per bit there is a
    cell for each common prefix in which rows with a 1 in the first hour meet
    rows with a 0 in the second. ``forward`` tells which of the two is the base.
    """
    seconds = events.groupBy(*SESSION, "epoch", "cmd").agg(F.count("*").alias("n"))
    shared = F.col("bit") < 0
    second = F.pmod(F.col("epoch"), F.lit(WINDOW_SECONDS)).cast("int")
    # One place for the shared hour, and two per bit, one in each direction.
    bits = F.array(*[F.lit(bit) for bit in range(-1, SECOND_BITS)])
    directions = F.when(shared, F.array(F.lit(True))).otherwise(
        F.array(F.lit(True), F.lit(False))
    )
    placed = (
        seconds.select("*", second.alias("second"), F.explode(bits).alias("bit"))
        .select("*", F.explode(directions).alias("forward"))
        .withColumn("one", shared | F.expr("(shiftright(second, bit) & 1) = 1"))
    )
    hour = _hour(F.col("epoch"))
    is_base = shared | (F.col("one") == F.col("forward"))
    is_partner = shared | (F.col("one") != F.col("forward"))
    placed = placed.select(
        *SESSION,
        "cmd",
        "epoch",
        F.when(F.col("one"), hour).otherwise(hour - 1).alias("hour"),
        "bit",
        F.when(shared, 0).otherwise(F.expr("shiftright(second, bit + 1)")).alias("prefix"),
        "forward",
        F.when(is_base, F.col("n")).otherwise(0).alias("b"),
        F.when(is_partner, F.col("n")).otherwise(0).alias("p"),
    )
    keys = [*SESSION, "hour", "bit", "prefix", "forward"]
    return (
        placed.groupBy(*keys, "cmd")
        .agg(
            F.sum("b").alias("b"),
            F.sum("p").alias("p"),
            F.max(F.when(F.col("p") > 0, F.col("epoch"))).alias("latest"),
        )
        .select(F.struct(*keys).alias("cell"), "cmd", "b", "p", "latest")
    )


def session_pairs(
    df: DataFrame, k: int = SESSION_COUNT, hot_rows: int = HOT_HOUR_ROWS
) -> DataFrame:
    """:func:`session_partners` for every command at once."""
    events = df.select(*SESSION, "epoch", "cmd").where(
        F.col("salt").isNotNull() & F.col("ppid").isNotNull() & F.col("epoch").isNotNull()
    )
    hot = _listed_if_few(
        events.groupBy(*SESSION, _hour(F.col("epoch")).alias("hour"))
        .agg(F.count("*").alias("rows"))
        .where(F.col("rows") > hot_rows)
        .select(*SESSION)
        .distinct()
    )
    if hot is None:
        return best_partners(_calm_session_pairs(events), k)
    calm = stage(_calm_session_pairs(events.join(hot, SESSION, "left_anti")), "session-calm")
    cells = _session_cells(events.join(hot, SESSION, "left_semi"))
    # All that lies within an hour of a row is in three hours of its session.
    hourly = events.groupBy(*SESSION, _hour(F.col("epoch")).alias("hour"), "cmd").agg(
        F.count("*").alias("n")
    )
    totals = hourly.groupBy("cmd").agg(
        (F.max("n") * 3).alias("widest"), F.sum("n").alias("weight")
    )
    totals = stage(totals, "session-totals")
    # A command runs in a cell no more often than anywhere.
    weights = totals.select("cmd", F.col("weight").alias("rank_by"))
    cells = stage(cells.join(weights, "cmd"), "session-cells")
    return best_partners(leading_pairs(cells, calm, k, totals), k)


def _direct_pairs(grouped: DataFrame) -> DataFrame:
    """Pair counts from all pairs of commands in a directory."""
    left = grouped.select("pwd", F.col("cmd").alias("a"), "n", F.col("latest").alias("at_a"))
    right = grouped.select(
        "pwd", F.col("cmd").alias("c"), F.col("n").alias("m"), F.col("latest").alias("at_c")
    )
    counted = (
        left.join(right, "pwd")
        .where(F.col("a") < F.col("c"))
        .groupBy("a", "c")
        .agg(
            F.sum(F.col("n").cast("decimal(19,0)") * F.col("m").cast("decimal(19,0)"))
            .cast(WIDE)
            .alias("n"),
            F.max("at_a").alias("last_a"),
            F.max("at_c").alias("last_c"),
        )
    )
    return _mirrored(counted)


def directory_pairs(
    df: DataFrame, k: int = DIRECTORY_COUNT, hot_commands: int = HOT_DIRECTORY_COMMANDS
) -> DataFrame:
    """:func:`directory_partners` for every command at once.

    Rows shrink to one per directory and command first. Directories with few
    commands join with themselves; the others go through lists of leaders.
    """
    grouped = (
        df.where(F.col("pwd").isNotNull())
        .groupBy("pwd", "cmd")
        .agg(F.count("*").alias("n"), F.max("epoch").alias("latest"))
    )
    grouped = stage(grouped, "directory-commands")
    hot = _listed_if_few(
        grouped.groupBy("pwd")
        .agg(F.count("*").alias("commands"))
        .where(F.col("commands") > hot_commands)
        .select("pwd")
    )
    if hot is None:
        return best_partners(_direct_pairs(grouped), k)
    calm = stage(_direct_pairs(grouped.join(hot, "pwd", "left_anti")), "directory-calm")
    cells = grouped.join(hot, "pwd", "left_semi").select(
        F.col("pwd").alias("cell"),
        "cmd",
        F.col("n").alias("b"),
        F.col("n").alias("p"),
        F.col("n").alias("rank_by"),
        "latest",
    )
    cells = stage(cells, "directory-cells")
    return best_partners(leading_pairs(cells, calm, k), k)


def tool_pairs(df: DataFrame, k: int = TOOL_COUNT) -> DataFrame:
    """:func:`tool_partners` for every command at once.

    A tool keeps its newest ``k + 1`` commands, enough after dropping the base.
    """
    commands = df.groupBy("cmd").agg(F.max("epoch").alias("latest"))
    newest = Window.partitionBy("tool").orderBy(F.desc("latest"), "cmd")
    leaders = (
        commands.where(F.col("cmd").contains(" "))
        .withColumn("tool", ascii_lower(F.substring_index("cmd", " ", 1)))
        .withColumn("place", F.row_number().over(newest))
        .where(F.col("place") <= k + 1)
    )
    bases = commands.select(
        F.col("cmd").alias("base"), ascii_lower(first_word(F.col("cmd"))).alias("tool")
    )
    among = Window.partitionBy("base").orderBy("place")
    return (
        bases.join(leaders, "tool")
        .where(F.col("base") != F.col("cmd"))
        .withColumn("rank", F.row_number().over(among))
        .where(F.col("rank") <= k)
        .select("base", "rank", "cmd", "latest")
    )


# Combined suggestions ------------------------------------------------------

# Order of the four lists in a combined answer.
SEMANTIC, TOOL, IN_SESSION, IN_DIRECTORY = 1, 2, 3, 4


def semantic_list(bases: DataFrame) -> DataFrame:
    """Fixed advice for each row of ``bases(base)``."""
    return bases.select("base", F.posexplode(semantic_suggestions(F.col("base")))).select(
        "base",
        F.lit(SEMANTIC).alias("list_no"),
        (F.col("pos") + 1).alias("rank"),
        F.col("col").alias("cmd"),
    )


def combine_lists(lists: list[DataFrame], limit: int = SUGGESTIONS) -> DataFrame:
    """First ``limit`` distinct commands per base in (list, rank) order."""
    everything = reduce(DataFrame.unionByName, lists).where(F.col("cmd") != F.col("base"))
    place = F.struct("list_no", "rank")
    order = Window.partitionBy("base").orderBy("place")
    return (
        everything.groupBy("base", "cmd")
        .agg(F.min(place).alias("place"))
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= limit)
        .select("base", "position", "cmd", "place.list_no", "place.rank")
    )


def _as_list(partners: DataFrame, cmd: str, list_no: int, order: list) -> DataFrame:
    """A ranked list of a handful of rows for one base command."""
    rank = F.row_number().over(Window.orderBy(*order))
    return partners.select(
        F.lit(cmd).alias("base"), F.lit(list_no).alias("list_no"), rank.alias("rank"), "cmd"
    )


def suggestions(df: DataFrame, cmd: str, limit: int = SUGGESTIONS) -> DataFrame:
    """Related commands of ``cmd``: advice, same tool, same session, same place."""
    counted = [F.desc("co_occurrences"), F.desc("latest"), "cmd"]
    base = df.sparkSession.range(1).select(F.lit(cmd).alias("base"))
    return combine_lists(
        [
            semantic_list(base),
            _as_list(tool_partners(df, cmd), cmd, TOOL, [F.desc("latest"), "cmd"]),
            _as_list(session_partners(df, cmd), cmd, IN_SESSION, counted),
            _as_list(directory_partners(df, cmd), cmd, IN_DIRECTORY, counted),
        ],
        limit,
    )


def suggestions_all(df: DataFrame, limit: int = SUGGESTIONS) -> DataFrame:
    """:func:`suggestions` for every command of the table."""

    def listed(pairs: DataFrame, list_no: int) -> DataFrame:
        return pairs.select("base", F.lit(list_no).alias("list_no"), "rank", "cmd")

    bases = df.select(F.col("cmd").alias("base")).distinct()
    return combine_lists(
        [
            semantic_list(bases),
            listed(tool_pairs(df), TOOL),
            listed(session_pairs(df), IN_SESSION),
            listed(directory_pairs(df), IN_DIRECTORY),
        ],
        limit,
    )
