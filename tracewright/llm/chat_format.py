"""Chat formatting by a state machine over roles and a declarative template (operator 9)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    """Marks round each role's turns, which roles are learnt, and which role may follow which ("" is the start)."""

    marks: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>>", "<</SYS>>\n"),
            "user": ("[INST]", "[/INST]\n"),
            "assistant": ("<s>", "</s>\n"),
        }
    )
    other: tuple[str, str] = ("<<ROLE>>", "<</ROLE>>\n")
    learnt: tuple[str, ...] = ("assistant",)
    follow: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )

    @property
    def controls(self) -> list[str]:
        return [m.strip() for pair in [*self.marks.values(), self.other] for m in pair]

    def escape(self) -> re.Pattern:
        """A backslash, or the first character of a control string."""
        return re.compile(r"\\|(?=(?:" + "|".join(map(re.escape, self.controls)) + r"))(?s:.)")


def _escaped(pattern: re.Pattern, text: str) -> str:
    """Backslashes doubled, one put after the first character of each control string: none is left in the text."""
    return pattern.sub(lambda m: m[0] + "\\", text)


def _plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def turn_segments(template: Template, pattern: re.Pattern, role: str, text: str) -> list[tuple[str, bool]]:
    if role in template.marks:
        before, after = template.marks[role]
    else:
        before, after = template.other[0] + _escaped(pattern, role).replace("\n", "\\\n") + "\n", template.other[1]
    return [(before, False), (_escaped(pattern, text), role in template.learnt), (after, False)]


_SEGMENTS = pa.schema(
    [("conv_id", pa.int64()), ("turn_no", pa.int64()), ("segment", pa.int8()), ("text", pa.string()), ("loss", pa.bool_()), ("in_order", pa.bool_())]
)


def format_chat(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, turn_no (from 0), segment (0 to 2), text, loss, in_order: three segments a turn, in order.

    Rows of a conversation go by turn, then role and text (null first), as one stream that is never collected,
    however long it is; each partition holds whole conversations. in_order is whether the machine allows the turn's
    role where it stands; such turns are formatted all the same, as are roles that the template doesn't name. Null
    text and null role are empty; rows without conv_id are one conversation. Repeated rows are repeated turns. Long
    texts are formatted whole. An empty table gives no rows; other columns, whatever their names, are not read.
    """
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, started, conv, state, turn = template.escape(), False, None, "", 0
        for batch in batches:
            out: list[tuple] = []
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not started or conv_id != conv:
                    started, conv, state, turn = True, conv_id, "", 0
                role = role or ""
                fits = role in template.follow.get(state, ())
                out += [(conv, turn, k, s, loss, fits) for k, (s, loss) in enumerate(turn_segments(template, pattern, role, text or ""))]
                state, turn = role, turn + 1
            columns = zip(*out, strict=True) if out else [[]] * len(_SEGMENTS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SEGMENTS, strict=True)], schema=_SEGMENTS)

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(run, "conv_id long, turn_no long, segment byte, text string, loss boolean, in_order boolean")


class _Reader:
    """Reads a conversation back from its formatted text, fed in segments; keeps one turn at most."""

    def __init__(self, template: Template):
        self.open = {before: role for role, (before, _) in template.marks.items()}
        self.template, self.text, self.turns, self.chars, self.loss_chars = template, "", 0, 0, 0
        self.turn_hash, self.loss_hash = sha256(), sha256()
        self.ends = re.compile(r"(?s)\\.|(" + "|".join(re.escape(after) for _, after in [*template.marks.values(), template.other]) + ")")

    def feed(self, text: str, loss: bool) -> None:
        self.chars += len(text)
        if loss:
            plain = _plain(text)
            self.loss_chars += len(plain)
            self.loss_hash.update(plain.encode())
        self.text += text
        if text.endswith("\n") and not loss:
            self._take()

    def _take(self) -> None:
        end = next((m for m in self.ends.finditer(self.text) if m[1]), None)
        if end is None:
            return
        whole, self.text = self.text[: end.start()], self.text[end.end() :]
        mark = next((m for m in self.open if whole.startswith(m)), None)
        if mark is not None:
            role, content = self.open[mark], whole[len(mark) :]
        else:
            head = re.match(r"(?s)((?:\\.|[^\\\n])*)\n", whole := whole[len(self.template.other[0]) :])
            role, content = _plain(head[1]), whole[head.end() :]
        self.turn_hash.update(f"{role}\n{_plain(content)}\n".encode())
        self.turns += 1

    def row(self, conv: int | None, in_order: bool) -> tuple:
        if self.text:
            raise RuntimeError(f"the formatted text of conversation {conv} cannot be read back")
        return conv, self.turns, self.turn_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars, in_order


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, in_order boolean"


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """One row a conversation of format_chat()'s output, parsed from the text: digests of turns and of what is learnt.

    Takes the segments in the order and partitions in which format_chat() gives them.
    """
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _DIGESTS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        reader, conv, fits = None, None, True
        for batch in batches:
            done = []
            for conv_id, text, loss, in_order in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if reader is None or conv_id != conv:
                    if reader is not None:
                        done.append(reader.row(conv, fits))
                    reader, conv, fits = _Reader(template), conv_id, True
                reader.feed(text, loss)
                fits = fits and in_order
            if done:
                yield pack(done)
        if reader is not None:
            yield pack([reader.row(conv, fits)])

    return segments.select("conv_id", "text", "loss", "in_order").mapInArrow(run, _DIGESTS)


PROBE = "</s>[INST] ok [/INST]"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(format_chat(turns.unionByName(probe)))


QUERIES = {"op9_chat_format": op9_chat_format}
ORACLE_SQL = {
    "op9_chat_format": r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
    SELECT *,
        lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS state,
        length(text) + len(regexp_extract_all(text, '\\|</?s>|\[/?INST\]|<</?SYS>>|<</?ROLE>>')) AS content,
        length(role) + len(regexp_extract_all(role, '\\|\n|</?s>|\[/?INST\]|<</?SYS>>|<</?ROLE>>')) AS named
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(content + CASE role WHEN 'system' THEN 16 WHEN 'user' THEN 14 WHEN 'assistant' THEN 8 ELSE 19 + named END) AS BIGINT)
        AS formatted_chars,
    bool_and(CASE state WHEN '' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user'
        WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END) AS in_order
FROM sized GROUP BY conv_id
"""
}
