"""Evidence tables of the memory audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRUNCATED = "\n[... tool result truncated ...]\n"


def aliases(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The smallest id of each text, by its SHA-256, and how many share it.

    Groups are pre-aggregated and joined back, so a text that many rows have is not gathered in one task."""
    keyed = rows.select(F.col(id_col), F.sha2(F.col(text_col), 256).alias("__key"))
    groups = keyed.groupBy("__key").agg(F.min(id_col).alias("canonical"), F.count("*").alias("copies"))
    return keyed.join(groups, "__key").drop("__key")


def evidence(events: DataFrame, redact, edge: int = 1000) -> DataFrame:
    """session_id, idx, role, text (redacted) and antecedent, the last assistant message before it.

    Texts are whole but for tool results of over two edges, which keep one at each end round a mark."""
    before = Window.partitionBy("session_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    antecedent = F.last(F.when(F.col("kind") == "assistant_msg", F.col("idx")), ignorenulls=True).over(before)
    role = F.when(F.col("kind") == "user_msg", "user").when(F.col("kind") == "assistant_msg", "assistant").otherwise("tool")
    text = redact(F.col("text"))
    ends = F.concat(F.left(text, F.lit(edge)), F.lit(TRUNCATED), F.right(text, F.lit(edge)))
    shown = F.when((F.col("kind") == "tool_result") & (F.length(text) > 2 * edge), ends).otherwise(text)
    return events.filter("kind <> 'meta'").select("session_id", "idx", role.alias("role"), shown.alias("text"), antecedent.alias("antecedent"))


def chunks(rows: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """Overlapping pieces of `size` characters, one at least."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text_col) - overlap) / step)).cast("long")
    cut = rows.select(id_col, text_col, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk"))
    return cut.select(id_col, "chunk", F.substring(F.col(text_col), (F.col("chunk") * step + 1).cast("int"), F.lit(size)).alias("part"))


#: Ids that one lane packs, and hooks that a user may give.
LANE_ROWS, MOST_HOOKS = 100_000, 1000


def batches(rows: DataFrame, id_col: str, size_col: str, limit: int, lane_rows: int = LANE_ROWS) -> DataFrame:
    """Ids packed in order into batches of at most `limit` bytes; a larger one is alone.

    Packing is sequential, so it runs in lanes of a hash of the id, each a grouped stage of narrow rows that numbers
    its own batches. There is a lane for each `lane_rows` rows, so a lane's size does not grow with the table; each
    ends in at most one part-filled batch."""
    import pandas as pd

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(id_col)
        out, batch, fill = [], 0, 0
        for size in frame[size_col]:
            if fill and fill + size > limit:
                batch, fill = batch + 1, 0
            fill += size
            out.append(batch)
        return frame[[id_col, "lane", size_col]].assign(batch=out)

    lanes = max(1, -(-rows.count() // lane_rows))
    number = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long")
    laned = rows.select(id_col, size_col, (number % lanes).alias("lane"))
    kind = rows.schema[id_col].dataType.simpleString()
    return laned.groupBy("lane").applyInPandas(pack, f"{id_col} {kind}, lane long, {size_col} long, batch long")


def _settings(table: DataFrame, most: int) -> list:
    """The rows of a table that people write by hand; a larger one is refused."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a configuration table has at most {most} rows")
    return rows


def hooks(commands: DataFrame, table: DataFrame) -> DataFrame:
    """Per hook (a pattern that a user gives) and what it extracts, commands and sessions.

    The hooks are a configuration table: each becomes a column expression, so nothing is joined."""
    wanted = [(r.hook, r.pattern) for r in _settings(table, MOST_HOOKS)]
    found = F.array(*(F.struct(F.lit(h).alias("hook"), F.when(F.col("command").rlike(p), F.regexp_extract("command", p, 0)).alias("value")) for h, p in wanted))
    rows = commands.select("session_id", F.inline(found)).filter("value is not null")
    return rows.groupBy("hook", "value").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"))


def recurrence(rows: DataFrame, item: str, group: Column, least: int) -> DataFrame:
    """Whether evidence for an item comes from enough independent groups."""
    per = rows.withColumn("__group", group).groupBy(F.col(item).alias("item")).agg(F.count("*").alias("n"), F.countDistinct("__group").alias("groups"))
    return per.withColumn("recurs", F.col("groups") >= least)
