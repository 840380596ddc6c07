"""Exact duplicates by owners in Patricia tries.

A task first joins the copies inside a block of rows, so a block sends each of its texts once.
Texts go to partitions by their length and a hash of their content, where the full byte strings are
put into a compressed radix trie; a terminal node holds the owner's id and the number of rows.
Partitions are sized so that a trie fits its bound.  One that does not fit gives up its heaviest
subtree, which is written to the shared folder with the round's results and dealt anew, into more
partitions.  A text that stands in very many blocks is joined in several levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.llm.tables import raw_texts, slices, text_only, written

# Text bytes and rows of a block; text bytes meant for a partition; bytes that a trie may hold.
BLOCK_BYTES = 8 * 1024 * 1024
BLOCK_ROWS = 20_000
PART_BYTES = 16 * 1024 * 1024
TRIE_BYTES = 48 * 1024 * 1024
# Entries of one text that meet in one partition; a text in more blocks is joined in levels.
FAN = 64
# Bytes that a node takes besides its label, counted against the bound of a trie.
NODE_BYTES = 400

BLOCKS = "block long, local int, length long, hash long, text binary, owner long, n long, members array<long>, sha256 string"
ENTRIES = ["block", "local", "length", "hash", "text", "owner", "n"]
ANSWERS = "block long, local int, length long, hash long, text binary, owner long, n long, spilled boolean"
MERGED = "block long, local int, length long, hash long, text binary, owner long, n long, members array<struct<block:long,local:int>>"


def better(a: int | None, b: int | None, smallest: bool) -> int | None:
    """The id that owns a text; null only where there is no other."""
    if a is None or b is None:
        return b if a is None else a
    return min(a, b) if smallest else max(a, b)


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Node:
    """The end of a labelled edge; ``entries`` are there only if a string ends here."""

    __slots__ = ("entries", "gone", "kids", "label", "n", "owner")

    def __init__(self, label: bytes):
        self.label, self.kids = label, {}
        self.owner, self.n, self.entries, self.gone = None, 0, None, False


class Patricia:
    """A compressed radix trie of byte strings with an owner, a count and the entries of each."""

    def __init__(self, smallest: bool):
        self.root, self.smallest, self.held, self.strings = Node(b""), smallest, NODE_BYTES, 0

    def place(self, key: bytes) -> Node:
        """The node at which ``key`` ends, made if it is not there; a node that was given up stops the walk."""
        node, at = self.root, 0
        while at < len(key) and not node.gone:
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = Node(key[at:])
                self.held += NODE_BYTES + len(kid.label)
                return kid
            size = len(kid.label)
            if key.startswith(kid.label, at):
                node, at = kid, at + size
                continue
            common = shared_prefix(kid.label, key[at : at + size])
            # Part the edge: a new node takes what both have, the old one keeps its rest.
            middle = node.kids[key[at]] = Node(kid.label[:common])
            kid.label = kid.label[common:]
            middle.kids[kid.label[0]] = kid
            # Strings below a node that was given up start with its whole label, so a parted edge is no loss.
            self.held += NODE_BYTES
            node, at = middle, at + common
        return node

    def insert(self, key: bytes, owner: int | None, n: int, entry: tuple) -> bool:
        """Add an entry of a string; false if it belongs to a subtree that was given up."""
        node = self.place(key)
        if node.gone:
            return False
        if node.entries is None:
            node.entries, node.owner = [], owner
            self.strings += 1
        node.owner = better(node.owner, owner, self.smallest)
        node.n += n
        node.entries.append((*entry, owner, n))
        self.held += 100
        return True

    def terminals(self, start: Node, prefix: bytes) -> Iterator[tuple[bytes, Node]]:
        """Strings and their nodes below a node, without recursion."""
        pending = [(start, prefix)]
        while pending:
            node, path = pending.pop()
            if node.entries is not None:
                yield path, node
            pending.extend((kid, path + kid.label) for kid in node.kids.values())

    @staticmethod
    def weight(start: Node) -> tuple[int, int]:
        """Bytes and strings of a subtree."""
        pending, held, strings = [start], 0, 0
        while pending:
            node = pending.pop()
            held += NODE_BYTES + len(node.label) + 100 * len(node.entries or ())
            strings += node.entries is not None
            pending.extend(node.kids.values())
        return held, strings

    def give_up(self) -> Iterator[tuple[bytes, Node]]:
        """Cut off the heaviest subtree of at most half the trie's bytes, if there is one; its strings come back here only."""
        node, path, bound = self.root, b"", self.held // 2
        while True:
            living = [k for k in node.kids.values() if not k.gone]
            if not living:
                return
            weights = [(*self.weight(k), k) for k in living]
            held, strings, kid = max(weights, key=lambda w: w[0])
            if held <= bound or strings == 1:
                break
            node, path = kid, path + kid.label
        if self.strings <= 1:
            return
        yield from self.terminals(kid, path + kid.label)
        self.held -= held - NODE_BYTES - len(kid.label)
        self.strings -= strings
        kid.kids, kid.entries, kid.gone = {}, None, True


def blocks(docs: DataFrame, smallest: bool) -> DataFrame:
    """Every text once for each block of rows that holds it, A-Z in lower case; written once.

    ``members`` are the ids of the block's rows with the text.
    """
    names = ["block", "local", "length", "hash", "text", "owner", "n", "members", "sha256"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        held: dict[bytes, list[int | None]] = {}
        size = rows = 0

        def packed() -> pa.RecordBatch:
            columns: list[list] = [[] for _ in names]
            for local, (text, members) in enumerate(held.items()):
                digest = hashlib.sha256(text)
                known = [m for m in members if m is not None]
                owner = (min(known) if smallest else max(known)) if known else None
                row = (block, local, len(text), int.from_bytes(digest.digest()[:8], "little", signed=True), text, owner, len(members), members, digest.hexdigest())
                for column, value in zip(columns, row):
                    column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for piece in slices(batches):
            for doc_id, raw in zip(piece.column("doc_id").to_pylist(), raw_texts(piece)):
                text = raw.lower()
                members = held.get(text)
                if members is None:
                    members = held[text] = []
                    size += len(text)
                members.append(doc_id)
                rows += 1
            if size >= BLOCK_BYTES or rows >= BLOCK_ROWS:
                yield packed()
                held, size, rows, block = {}, 0, 0, block + 1
        if held:
            yield packed()

    return written(docs.mapInArrow(run, BLOCKS), "dedup-blocks")


def tried(entries: DataFrame, by: list[str], parts: int, smallest: bool, trie_bytes: int, merge: bool) -> DataFrame:
    """Entries dealt by ``by`` into tries.

    With ``merge``, every text becomes one entry of a block of this round, with its entries as
    members (or more than one where a subtree was given up: the next level joins them).  Otherwise
    every entry comes back with its text's owner and count, and the entries of a subtree that was
    given up with their texts, as ``spilled``.
    """
    names = ["block", "local", "length", "hash", "text", "owner", "n", "members" if merge else "spilled"]
    last = pa.list_(pa.struct([("block", pa.int64()), ("local", pa.int32())])) if merge else pa.bool_()
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), last]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        local = 0
        trie = Patricia(smallest)

        def results(found: Iterator[tuple[bytes, Node]], spilled: bool) -> Iterator[tuple]:
            nonlocal local
            for text, node in found:
                if merge:
                    members = [{"block": b, "local": i} for b, i, _, _, _, _ in node.entries]
                    yield block, local, len(text), node.entries[0][3], text, node.owner, node.n, members
                    local += 1
                    continue
                for b, i, length, content, owner, n in node.entries:
                    yield (b, i, length, content, text, owner, n, True) if spilled else (b, i, None, None, None, node.owner, node.n, False)

        def sent(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            pending, size = [], 0
            for row in rows:
                pending.append(row)
                size += len(row[4] or b"") + 64
                if size >= BLOCK_BYTES:
                    yield batch_of(pending)
                    pending, size = [], 0
            if pending:
                yield batch_of(pending)

        for piece in slices(batches):
            late = []
            columns = [piece.column(c).to_pylist() for c in ("block", "local", "length", "hash", "owner", "n")]
            for text, b, i, length, content, owner, n in zip(raw_texts(piece), *columns):
                if not trie.insert(text, owner, n, (b, i, length, content)):
                    members = [{"block": b, "local": i}]
                    late.append((block, local, length, content, text, owner, n, members) if merge else (b, i, length, content, text, owner, n, True))
                    local += 1
            if late:
                yield from sent(iter(late))
            while trie.held > trie_bytes:
                before = trie.held
                yield from sent(results(trie.give_up(), True))
                if trie.held == before:
                    break
        yield from sent(results(trie.terminals(trie.root, b""), False))

    dealt = entries.select(*ENTRIES, *(c for c in by if c not in ENTRIES)).repartition(parts, *by).select(*ENTRIES)
    return written(dealt.mapInArrow(run, MERGED if merge else ANSWERS), "dedup-merged" if merge else "dedup-answers")


def _parts(entries: DataFrame, part_bytes: int) -> int:
    return max(1, -(-(entries.agg(F.sum(F.octet_length("text") + F.lit(NODE_BYTES))).first()[0] or 0) // part_bytes))


def owners(entries: DataFrame, smallest: bool, fan: int, part_bytes: int, trie_bytes: int) -> DataFrame:
    """``block``, ``local``, ``owner`` and ``n`` (rows with the text, in all blocks) of every entry."""
    # Texts in more blocks than one partition should meet; told by length and hash, which only decides the way they take.
    crowds = entries.groupBy("length", "hash").agg(F.count("*").alias("crowd")).where(F.col("crowd") > fan)
    crowds = written(crowds, "dedup-crowds")
    known = []
    if crowds.limit(1).count():
        beside = entries.join(crowds, ["length", "hash"], "left")
        salt = F.pmod(F.xxhash64("block", "local"), F.expr(f"crowd div {fan} + 1"))
        hot = beside.where("crowd is not null").withColumn("salt", salt)
        merged = tried(hot, ["length", "hash", "salt"], _parts(hot, part_bytes), smallest, trie_bytes, merge=True)
        # A wider fan above, so that the levels end even where tries could not hold their texts.
        above = owners(merged.select(*ENTRIES), smallest, 2 * fan, part_bytes, trie_bytes)
        members = merged.select("block", "local", "members").join(above, ["block", "local"])
        known.append(members.select(F.explode("members").alias("m"), "owner", "n").select("m.*", "owner", "n"))
        entries = beside.where("crowd is null").select(*ENTRIES)
    parts = _parts(entries, part_bytes)
    while True:
        answers = tried(entries, ["length", "hash"], parts, smallest, trie_bytes, merge=False)
        known.append(answers.where("not spilled").select("block", "local", "owner", "n"))
        entries = answers.where("spilled").select(*ENTRIES)
        if not entries.limit(1).count():
            break
        # What was given up is dealt into more partitions, of a number that shares nothing with the last.
        parts = 2 * max(parts, _parts(entries, part_bytes)) + 1
    out = known[0]
    for more in known[1:]:
        out = out.union(more)
    return out


def exact_duplicates(
    docs: DataFrame, keep: str = "largest", fan: int = FAN, part_bytes: int = PART_BYTES, trie_bytes: int = TRIE_BYTES
) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of every row.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the
    ``keep`` ("largest" or "smallest") id stays.  ``text_sha256`` is of the normalised text.

    Null texts count as empty, and empty texts equal each other.  A null id never stays where an
    equal text has an id; where none has, ``keep_id`` is null and all its rows stay, as do rows that
    share both id and text: nothing tells them apart.  Every row counts in ``group_size``.  An empty
    table gives no rows.  Other columns are not read.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep is largest or smallest, not {keep!r}")
    held = blocks(text_only(docs), keep == "smallest")
    found = owners(held.select(*ENTRIES), keep == "smallest", fan, part_bytes, trie_bytes)
    found = found.select("block", "local", F.col("owner").alias("keep_id"), F.col("n").alias("group_size"))
    rows = held.select("block", "local", "members", "sha256").join(found, ["block", "local"])
    rows = rows.select(F.explode("members").alias("doc_id"), "keep_id", "group_size", F.col("sha256").alias("text_sha256"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def deduplicated(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, all columns, by id; rows without an id stay only where their text has no owner."""
    kept = exact_duplicates(docs, keep).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    kept = kept.distinct()
    lowered = F.translate(F.coalesce(docs["text"].cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    same = docs["doc_id"].eqNullSafe(F.col("kept_id")) & (F.sha2(lowered, 256) == F.col("kept_sha"))
    return docs.join(kept, same, "left_semi")
