"""Chat formatting, with turn spans found by rendering a template as a black box.

A template is any function from a list of messages to a string. Each prefix
of a conversation is rendered in turn: where the output only grows, what was
added is the turn's span; where what was written before changes, the template
rewrites history and the conversation is marked so. Inside an assistant's
span, the text is located by rendering the same prefix with a probe in place of
the last text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.llm.common import table, with_ids

Message = tuple[str, str]
Template = Callable[[Sequence[Message]], str]

END = "</turn>\n"
#: Two private-use characters that stand in for a text, one at a time.
PROBES = ("\ue0f0", "\ue0f1")


def escape(text: str) -> str:
    """``text`` without any control string of the template: backslashes, number signs and the slash of ``</`` get a backslash."""
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</", "<\\/")


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def marked_turns(messages: Sequence[Message]) -> str:
    """The template of the query: ``### role: text</turn>``, a line break after each turn, control strings escaped."""
    return "".join(f"### {escape_role(role)}: {escape(text)}{END}" for role, text in messages)


HEADER = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*): ", re.S)
#: Characters of output that a batch of results holds before it is passed on.
BATCH_CHARS = 4_000_000


def read_back(formatted: str) -> list[Message]:
    """The messages that ``marked_turns`` wrote."""
    out, at = [], 0
    while at < len(formatted):
        m = HEADER.match(formatted, at)
        end = formatted.find(END, m.end()) if m else -1
        if end < 0:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(m[1]), unescape(formatted[m.end() : end])))
        at = end + len(END)
    return out


@dataclass
class Rendering:
    text: str = ""
    #: of each turn, where what it added begins and ends
    spans: list[tuple[int, int]] = field(default_factory=list)
    #: of each turn under the loss mask, where its text begins and ends
    loss: list[tuple[int, int]] = field(default_factory=list)
    #: the first turn whose rendering changed what was written before it, or -1
    rewrites_at: int = -1


def locate(template: Template, messages: Sequence[Message], shown: str, begin: int) -> tuple[int, int]:
    """Where the last message's text stands in ``shown``, the rendering of all messages.

    Two renderings differ in the probe alone, so the first place where they
    differ is where the text begins, and what follows it is what follows the text.
    """
    head, (role, _) = list(messages[:-1]), messages[-1]
    one, two = (template([*head, (role, p)]) for p in PROBES)
    at = next((i for i in range(min(begin, len(one)), min(len(one), len(two))) if one[i] != two[i]), -1)
    if at < 0 or one[:at] != shown[:at]:
        return begin, len(shown)
    tail = one[at + 1 :]
    return at, len(shown) - len(tail) if shown.endswith(tail) else len(shown)


def render(messages: Sequence[Message], template: Template = marked_turns, loss_roles: Sequence[str] = ("assistant",)) -> Rendering:
    """A conversation's rendering, turn spans and loss mask, from the template's outputs alone."""
    out = Rendering()
    for i in range(len(messages)):
        prefix = messages[: i + 1]
        shown = template(prefix)
        if not shown.startswith(out.text) and out.rewrites_at < 0:
            out.rewrites_at = i
        begin = min(len(out.text), len(shown))
        if out.rewrites_at < 0:
            out.spans.append((begin, len(shown)))
            if messages[i][0] in loss_roles:
                out.loss.append(locate(template, prefix, shown, begin))
        out.text = shown
    if out.rewrites_at >= 0:
        # spans that were found before the rewrite no longer hold
        out.spans, out.loss = [], []
    return out


def digest(conv_id, messages: Sequence[Message]) -> tuple:
    shown = render(messages)
    turns = read_back(shown.text)
    said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
    learnt = "".join(unescape(shown.text[a:b]) for a, b in shown.loss)
    return (
        conv_id, len(turns), said, len(learnt), hashlib.sha256(learnt.encode("utf-8", "surrogatepass")).hexdigest(),
        len(shown.text), shown.text, [x for s in shown.spans for x in s], [x for s in shown.loss for x in s], shown.rewrites_at,
    )


COLUMNS = {
    "conv_id": "long", "n_turns": "long", "turns_sha256": "string", "loss_chars": "long", "loss_sha256": "string", "formatted_chars": "long",
    "formatted": "string", "turn_spans": "array<long>", "loss_spans": "array<long>", "rewrites_at": "long",
}


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: digests read back from the output, and ``formatted``, ``turn_spans``, ``loss_spans``, ``rewrites_at``.

    Rows go by turn (null first), then role and text, so repeated turns have a
    defined order. A null role or text is empty; rows with a null ``conv_id``
    are one conversation; no rows give no rows; extra columns are ignored. A
    conversation is one output string and so is put together in one place.
    """
    listed = (
        with_ids(turns, "conv_id", "turn", "role", "text")
        .select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("row"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("row")).alias("rows"))
        .select("conv_id", F.col("rows.role").alias("roles"), F.col("rows.text").alias("texts"))
    )

    def batches(it):
        made, held = [], 0
        for batch in it:
            for row in batch.to_pylist():
                made.append(digest(row["conv_id"], list(zip(row["roles"], row["texts"]))))
                held += made[-1][5]
                if held > BATCH_CHARS or len(made) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made), SCHEMA)], schema=SCHEMA)
                    made, held = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made), SCHEMA)], schema=SCHEMA)

    return listed.mapInArrow(batches, ", ".join(f"{k} {v}" for k, v in COLUMNS.items()))


SCHEMA = pa.schema([(k, {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}[v]) for k, v in COLUMNS.items()])


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = with_ids(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").union(extra)
    return format_conversations(turns).drop("formatted", "turn_spans", "loss_spans", "rewrites_at")


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</', '<\/')) AS n_text,
        length(replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</', '<\/'), ':', '\:')) AS n_role FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + n_role + 2 + n_text + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
