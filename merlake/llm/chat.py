"""Chat formatting of reply trees.

Messages form trees through their parents.  Iterative self-joins by pointer doubling (an
ancestor table for each power of two) give every branch its score and length, branches are
ranked within their tree, and the chosen ones are expanded from leaf to root, again in as
many joins as the longest branch has binary digits.  Each chosen path is formatted as one
conversation, in segments of a turn each, with the loss mask on the assistant's texts.

The template marks user turns ``[INST] .. [/INST]``, assistant turns ``<s>.. </s>``, system
turns ``<<SYS>> .. <</SYS>>``, and other roles by name.  Control strings inside a text get a
backslash after their first character, and backslashes are doubled, so that a formatted
conversation can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, parts

#: Fixed values of the template: the marks around a turn's text by role, and for other roles.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", " </s>"), "system": ("<<SYS>>\n", "\n<</SYS>>")}
OTHER = ("<|role|>", "<|text|>", " <|end|>")
CONTROL = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<|role|>", "<|text|>", "<|end|>"]

_ESCAPED = re.compile("|".join(map(re.escape, ["\\", *CONTROL])))
_BACKSLASH = re.compile(r"\\(.)", re.DOTALL)
#: A null tree id is held as this one inside the joins.
_NO_TREE = -(2**63)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _BACKSLASH.sub(r"\1", text)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The turn's segment and the span of its text in it."""
    role, body = role or "", escape(text or "")
    if role in MARKS:
        before, after = MARKS[role]
    else:
        before, after = OTHER[0] + escape(role) + OTHER[1], OTHER[2]
    return before + body + after, len(before), len(before) + len(body)


class TurnReader:
    """Reads turns back from the pieces of a formatted conversation."""

    def __init__(self) -> None:
        self.held = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str, str]]:
        """(role, text, masked) of each turn that is whole; masked is the part under the loss."""
        self.held += piece
        while self.held:
            for role, (before, after) in MARKS.items():
                if self.held.startswith(before):
                    start, name = len(before), role
                    break
            else:
                if not self.held.startswith(OTHER[0]):
                    if len(self.held) > 16:
                        raise ValueError("no turn starts here")
                    return
                at, after = self.held.find(OTHER[1]), OTHER[2]
                if at < 0:
                    return
                start, name = at + len(OTHER[1]), unescape(self.held[len(OTHER[0]) : at])
            end = self.held.find(after, start)
            if end < 0:
                return
            text = unescape(self.held[start:end])
            self.held = self.held[end + len(after) :]
            yield name, text, text if name == "assistant" else ""


def reply_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """(tree, path, position, node) of the best branches of each tree.

    ``nodes`` has the long columns tree, node, parent (null or absent from the tree: a root)
    and a double, score (null: 0); (tree, node) names a row.  A branch runs from a root to a
    node without replies; its score is the sum of its nodes' scores.  The ``top`` branches of
    a tree are numbered from 0, of equal scores the longer first, then the smaller leaf.
    Nodes that reach no root, because their parents form a ring, are on no branch.
    """
    plain = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")).dropDuplicates(["tree", "node"])
    known = plain.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    base = plain.join(known, (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("n")), "left").select("tree", "node", F.col("n").alias("up"), "score", F.lit(1).cast("long").alias("length"))
    # at each power: the nodes whose ancestor at that distance is there, and those whose root is nearer
    state = materialise(base, "up0")
    total = state.count()
    rising, rooted = [state.where("up is not null")], [state.where("up is null")]
    while (1 << len(rising)) <= 2 * total and not rising[-1].isEmpty():
        every = rising[-1]
        for part in rooted:
            every = every.unionByName(part)
        above = every.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("u"), F.col("score").alias("s"), F.col("length").alias("l"))
        joined = rising[-1].join(above, (F.col("tree") == F.col("t")) & (F.col("up") == F.col("n")))
        state = materialise(joined.select("tree", "node", F.col("u").alias("up"), (F.col("score") + F.col("s")).alias("score"), (F.col("length") + F.col("l")).alias("length")), f"up{len(rising)}")
        rising.append(state.where("up is not null"))
        rooted.append(state.where("up is null"))
    whole = rooted[0]
    for part in rooted[1:]:
        whole = whole.unionByName(part)
    replied = rising[0].select(F.col("tree").alias("t"), F.col("up").alias("p")).distinct()
    leaves = whole.join(replied, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    order = Window.partitionBy("tree").orderBy(F.col("score").desc(), F.col("length").desc(), "node")
    chosen = leaves.withColumn("path", F.row_number().over(order) - 1).where(F.col("path") < top)
    rows = materialise(chosen.select("tree", "path", "node", (F.col("length") - 1).alias("position")), "leaves")
    for power in range(len(rising) - 1, -1, -1):
        above = rising[power].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        found = rows.join(above, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "path", F.col("up").alias("node"), (F.col("position") - (1 << power)).alias("position"))
        rows = rows.unionByName(found)
        if power % 4 == 0:
            rows = materialise(rows, "paths")
    return rows.select("tree", "path", "position", "node")


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """(tree, path, position, segment, start, end) of every turn of the chosen paths.

    ``messages`` has tree, node, role and text.  A conversation is its segments one after the
    other; start and end bound the text inside the segment, under the loss mask if the
    assistant's (else both are null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            roles, texts = (batch.column(names.index(c)).to_pylist() for c in ("role", "text"))
            made = [format_turn(r, t) for r, t in zip(roles, texts, strict=True)]
            spans = [(a, b) if r == "assistant" else (None, None) for r, (_, a, b) in zip(roles, made, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in ("tree", "path", "position")], pa.array([m[0] for m in made], pa.string()), pa.array([s[0] for s in spans], pa.int64()), pa.array([s[1] for s in spans], pa.int64())], names=["tree", "path", "position", "segment", "start", "end"])

    own = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    turns = paths.join(own, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "path", "position", "role", "text")
    return turns.mapInArrow(run, "tree long, path int, position long, segment string, start long, end long")


def read_back(segments: DataFrame) -> DataFrame:
    """(tree, path, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation.

    Reads the formatted text, not the table it was made from.  Segments are streamed in
    their order, so a task holds one turn at a time, however long a conversation is.
    """
    columns = ["tree", "path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, done = None, []
        reader, turns, loss, n, masked, chars = TurnReader(), hashlib.sha256(), hashlib.sha256(), 0, 0, 0

        def close() -> None:
            if key is not None:
                if reader.held:
                    raise ValueError("a conversation ends inside a turn")
                done.append((*key, n, turns.hexdigest(), masked, loss.hexdigest(), chars))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True) if done else [[]] * len(kinds), kinds, strict=True)], names=columns)
            done.clear()
            return out

        for batch in batches:
            for tree, path, segment, start, end in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("tree", "path", "segment", "start", "end")), strict=True):
                if (tree, path) != key:
                    close()
                    key = (tree, path)
                    reader, turns, loss, n, masked, chars = TurnReader(), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                chars += len(segment)
                for role, text, _ in reader.feed(segment):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                if start is not None:
                    under = unescape(segment[start:end])
                    loss.update(under.encode())
                    masked += len(under)
            yield flush()
        close()
        yield flush()

    spark = segments.sparkSession
    dealt = segments.repartition(parts(spark), "tree", "path").sortWithinPartitions("tree", "path", "position")
    return dealt.mapInArrow(run, "tree long, path int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def linear_messages(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations without branches as reply trees: tree, node, parent, score, role, text.

    Every row answers the one before it in the order of turns; rows of the same turn follow
    each other by role and text, nulls first.  Rows with a null id are one conversation.
    """
    rows = conversations.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_TREE)).alias("tree"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    node = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    numbered = rows.withColumn("node", node)
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """All rows of ``conversations`` formatted and read back: conv_id and the columns of read_back.

    A null text or role is empty.  Repeated rows are turns of their own.  Other columns are
    ignored; an empty table gives no rows.
    """
    messages = materialise(linear_messages(conversations), "messages")
    segments = materialise(format_paths(reply_paths(messages), messages), "segments")
    conv = F.when(F.col("tree") == _NO_TREE, F.lit(None)).otherwise(F.col("tree")).cast("long")
    return read_back(segments).select(conv.alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
