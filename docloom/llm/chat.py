"""Chat formatting in budgeted windows.

Prefix sums of the turns' tokens (words and two marks each) choose spans: a turn belongs to span
number floor(tokens before it / SPAN_TOKENS). A window is a span with, before it, the
conversation's system turn (if its first turn is one) and the last HISTORY turns before the span.
Those repeats are masked: only assistant texts of the span itself count for the loss, so each
assistant text is a target once.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. In roles and texts a backslash is
put between ``<`` (with the backslashes that follow it) and ``|``, so no control string remains;
reading takes one out again. In roles, backslashes and line ends are escaped too.

A conversation of any length is cut into ranges of RANGE turns for the prefix sums, and windows are
groups of bounded size, so no conversation is gathered. Only the reader's running digest of a
conversation passes one task, a row at a time.

Defined cases: a null text or role is empty; turns are ordered by turn (null first), then role,
then text; rows with a null conversation form one; repeated rows are turns of their own; a very long
text is a turn that fills its window alone; an empty table gives an empty one; other columns are not
read, whatever their names. Turns that share one number are ordered in one task.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

SPAN_TOKENS = 512
HISTORY = 2
RANGE = 256
START, END = "<|im_start|>", "<|im_end|>"

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\*)\\\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_window(turns: list[tuple[bool, str, str]]) -> tuple[str, list[int]]:
    """turns: (is it new, role, text). The formatted text, and the begin and end of each loss span."""
    out, mask, at = [], [], 0
    for new, role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if new and role == "assistant":
            mask += [at + len(head), at + len(head) + len(body)]
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), mask


def parse_window(formatted: str, n_repeated: int) -> list[tuple[str, str]]:
    """(role, text) of the turns that are new in a window."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)][n_repeated:]


def windows(turns: DataFrame, span_tokens: int = SPAN_TOKENS, history: int = HISTORY) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` to ``(conv_id, window, n_repeated, formatted, mask)``:
    mask holds begin and end of each loss span, in characters of ``formatted``."""
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")).alias("c"),
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.withColumns(
        {
            "r": F.coalesce(F.floor(F.col("turn") / RANGE), F.lit(-(1 << 62))).cast("long"),
            "tokens": (F.regexp_count("text", F.lit(WORD)) + 2).cast("long"),
        }
    )
    sums = rows.groupBy("c", "r").agg(
        F.sum("tokens").alias("part"),
        F.count("*").alias("n"),
        F.max_by("tokens", F.struct("turn", "role", "text")).alias("last"),
    )
    ahead = Window.partitionBy("c").orderBy("r")
    so_far = ahead.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "c",
        "r",
        F.coalesce(F.sum("part").over(so_far), F.lit(0)).alias("tokens_ahead"),
        F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("turns_ahead"),
        F.lag("last").over(ahead).alias("last"),
    )
    within = Window.partitionBy("c", "r").orderBy("turn", "role", "text")
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns(
        {"upto": F.sum("tokens").over(upto), "no": F.row_number().over(within), "lag": F.lag("tokens").over(within)}
    ).join(sums, ["c", "r"])
    before = F.col("tokens_ahead") + F.col("upto") - F.col("tokens")
    rows = rows.select(
        "c",
        "conv_id",
        (F.col("turns_ahead") + F.col("no") - 1).alias("at"),
        "role",
        "text",
        F.floor(before / span_tokens).cast("long").alias("window"),
        F.floor((before - F.coalesce("lag", "last")) / span_tokens).cast("long").alias("previous"),
    )
    rows = materialize(rows, "chat-turns")
    new = rows.select("c", "conv_id", "window", F.lit(2).alias("kind"), "at", "role", "text")
    first = rows.filter("at > 0 and (previous is null or previous <> window)").select("c", "window", "at")
    past = (
        rows.withColumn("back", F.explode(F.sequence(F.lit(1), F.lit(history))))
        .withColumn("to", F.col("at") + F.col("back"))
        .join(first.select("c", F.col("at").alias("to"), F.col("window").alias("w")), ["c", "to"])
        .filter("not (at = 0 and role = 'system')")
        .select("c", "conv_id", F.col("w").alias("window"), F.lit(1).alias("kind"), "at", "role", "text")
    )
    system = rows.filter("at = 0 and role = 'system'").select("c", "conv_id", "role", "text")
    again = first.join(system, "c").select("c", "conv_id", "window", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), "role", "text")
    grouped = (
        new.unionByName(past)
        .unionByName(again)
        .groupBy("c", "window")
        .agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("kind", "at", "role", "text"))).alias("turns"))
    )

    def run(batches):
        for batch in batches:
            repeated, texts, masks = [], [], []
            for turns in batch.column(2).to_pylist():
                text, mask = format_window([(t["kind"] == 2, t["role"], t["text"]) for t in turns])
                repeated.append(sum(t["kind"] < 2 for t in turns))
                texts.append(text)
                masks.append(mask)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(repeated, pa.int32()),
                    pa.array(texts, pa.string()),
                    pa.array(masks, pa.list_(pa.int32())),
                ],
                names=["conv_id", "window", "n_repeated", "formatted", "mask"],
            )

    return grouped.select("conv_id", "window", "turns").mapInArrow(
        run, "conv_id long, window long, n_repeated int, formatted string, mask array<int>"
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What the windows hold, by conversation: ``n_turns``, ``turns_sha256``, ``loss_chars``,
    ``loss_sha256`` and ``formatted_chars``. A conversation's windows pass in order and leave
    but a running digest."""
    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = formatted.repartition(n, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "window")

    def run(batches):
        state = None

        def result(s):
            key, turns, all_, loss, loss_hash, size = s
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([key], pa.int64()),
                    pa.array([turns]),
                    pa.array([all_.hexdigest()]),
                    pa.array([loss]),
                    pa.array([loss_hash.hexdigest()]),
                    pa.array([size]),
                ],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

        for batch in batches:
            for key, repeated, text, mask in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if state is None or state[0] != key:
                    if state is not None:
                        yield result(state)
                    state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse_window(text, repeated):
                    state[1] += 1
                    state[2].update(f"{role}\n{body}\n".encode())
                for a, b in zip(mask[::2], mask[1::2]):
                    target = unescape(text[a:b])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(text)
        if state is not None:
            yield result(state)

    return rows.select("conv_id", "n_repeated", "formatted", "mask").mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
