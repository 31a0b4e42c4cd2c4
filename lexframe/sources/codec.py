"""The binary form of entries and indexes, driven by one table of layouts.

An entry is a dict with the fields of LAYOUTS; absent optional fields are None or empty lists. A
definition is ``{"Definition": {...}}`` or ``{"Group": {...}}``. Strings are UTF-8 after a varint
length, numbers little-endian, varints canonical LEB128 (an overlong or oversized one is an error).
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import zstandard

# Fixed values of the format. Per node the fields in stored order: name, type, and the flag bit that
# says whether the field is there (-1: always there). A type in brackets is a list; ``@pool`` an index
# into a string pool, 0 for none. Nodes in BARE have no byte of flags.
LAYOUTS: dict[str, list[tuple[str, str, int]]] = {
    "entry": [("see", "str", 0), ("tags", "[@tag]", 1), ("media", "[media]", 2), ("pron", "[pron]", 3), ("etymologies", "[ety]", 4), ("morphology", "[morpheme]", 5), ("relations", "[relation]", 6)],
    "ety": [("id", "str", 0), ("root", "str", 1), ("senses", "[sense]", 2)],
    "sense": [("pos", "@pos", -1), ("lemma", "str", 0), ("translations", "[translation]", 1), ("forms", "[form]", 2), ("tags", "[str]", 3), ("pron", "[pron]", 4), ("definitions", "[def]", -1)],
    "definition": [("value", "str", -1), ("id", "str", 0), ("examples", "[example]", 1), ("notes", "[note]", 2), ("media", "[media]", 3)],
    "group": [("id", "str", 0), ("description", "str", 1), ("definitions", "[def]", -1)],
    "example": [("value", "str", -1), ("translations", "[translation]", 0), ("pron", "[pron]", 1), ("media", "[media]", 2), ("targets", "[target]", 3)],
    "note": [("value", "str", -1), ("id", "str", 0), ("examples", "[example]", 1)],
    "translation": [("lang", "@lang", -1), ("value", "str", -1), ("pron", "[pron]", 0)],
    "pron": [("lang", "@lang", 0), ("accent", "str", 1), ("kind", "@pron_kind", -1), ("value", "str", -1), ("media", "[media]", 2)],
    "form": [("kind", "@form_kind", -1), ("term", "str", -1), ("tags", "[str]", 0), ("feats", "str", 1), ("pron", "[pron]", 2)],
    "media": [("kind", "kind", -1), ("hash", "hash", -1), ("description", "str", 0), ("alt", "str", 1)],
    "morpheme": [("kind", "@form_kind", -1), ("term", "str", -1)],
    "relation": [("type", "@relation_type", -1), ("target", "str", -1)],
    "target": [("spans", "[span]", -1)],
    "span": [("offset", "varint", -1), ("length", "varint", -1)],
}
BARE = ("relation", "target", "span")
MEDIA_KINDS = ("audio", "image", "video")
POOLS = ("pos", "lang", "pron_kind", "form_kind", "tag", "relation_type")
FRONT_BLOCK = 256


class Malformed(ValueError):
    """Bytes that don't follow the format."""


class Unknown(Malformed):
    """A record with flags or kinds of a later version: it stays opaque."""


@dataclass(frozen=True)
class Identity:
    """What names the format in its files; a parameter, so that other families can be read and written."""

    name: str = "lexpack"
    mimetype: bytes = b"application/x-lexpack"
    version: str = "0.1.0"
    strings: bytes = b"LXST"
    heads: bytes = b"LXID"
    tags: bytes = b"LXTI"
    morph: bytes = b"LXMI"


def varint(n: int) -> bytes:
    """Canonical LEB128 of a number below 2^64."""
    if not 0 <= n < 1 << 64:
        raise Malformed(f"{n} is no varint")
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def string(s: str) -> bytes:
    b = s.encode()
    return varint(len(b)) + b


class Cursor:
    """Reads within the bounds of a buffer."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Malformed("the data end too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, width: int) -> int:
        return int.from_bytes(self.take(width), "little")

    def varint(self) -> int:
        n = shift = 0
        while True:
            b = self.take(1)[0]
            n |= (b & 0x7F) << shift
            if b < 0x80:
                if n >= 1 << 64 or (b == 0 and shift):
                    raise Malformed("a varint isn't canonical")
                return n
            shift += 7
            if shift > 63:
                raise Malformed("a varint is too long")

    def string(self) -> str:
        try:
            return self.take(self.varint()).decode()
        except UnicodeDecodeError as e:
            raise Malformed("text isn't UTF-8") from e


# Per node what the loops below need of a layout: name, type, type of an element, flag bit, whether it is a list.
_PLAN = {node: [(name, kind, kind.strip("[]"), bit, kind[0] == "[") for name, kind, bit in layout] for node, layout in LAYOUTS.items()}
_KNOWN = {node: sum(1 << bit for _, _, bit in layout if bit >= 0) | (node == "morpheme") for node, layout in LAYOUTS.items()}
Number = Callable[[str, str], int]


def encode(node: str, value: dict, index: dict[str, dict[str, int]]) -> bytes:
    """The bytes of a node; index: per pool the 1-based number of each string (0 is written for others)."""
    out = bytearray()
    _put(out, node, value, lambda pool, s: index[pool].get(s, 0), [])
    return bytes(out)


def encode_noting(value: dict, number: Number) -> tuple[bytearray, list[tuple[int, str]]]:
    """The bytes of an entry, and (place, pool) of every number of a string in them; ``number`` is asked in stored order."""
    out, refs = bytearray(), []
    _put(out, "entry", value, number, refs)
    return out, refs


def _put(out: bytearray, node: str, value: dict, number: Number, refs: list, plan: list | None = None) -> None:
    flags, at = 0, len(out)
    if node not in BARE:
        out.append(0)
    for name, kind, inner, bit, listed in plan or _PLAN[node]:
        v = value.get(name)
        there = bool(v) if listed else v is not None
        if node == "morpheme" and name == "kind":
            flags |= there  # told by the flags, and written all the same
        if bit >= 0:
            if not there:
                continue
            flags |= 1 << bit
        if inner == "def":
            _put_definitions(out, v or (), number, refs)
        elif listed:
            out += varint(len(v or ()))
            for x in v or ():
                _put_one(out, inner, x, number, refs)
        else:
            _put_one(out, kind, v, number, refs)
    if node not in BARE:
        out[at] = flags


def _put_definitions(out: bytearray, definitions: list, number: Number, refs: list) -> None:
    """Definitions and groups of any depth, in stored order: the list of a group is its last field."""
    out += varint(len(definitions))
    stack = [iter(definitions)]
    while stack:
        d = next(stack[-1], None)
        if d is None:
            stack.pop()
        elif "Group" in d:
            out.append(1)
            _put(out, "group", d["Group"], number, refs, _PLAN["group"][:-1])
            inner = d["Group"].get("definitions") or ()
            out += varint(len(inner))
            stack.append(iter(inner))
        else:
            out.append(0)
            _put(out, "definition", d["Definition"], number, refs)


def _put_one(out: bytearray, kind: str, v: object, number: Number, refs: list) -> None:
    if kind == "str":
        out += string(v or "")
    elif kind[0] == "@":
        if v is not None:
            refs.append((len(out), kind[1:]))
        out += struct.pack("<H", number(kind[1:], v) if v is not None else 0)
    elif kind == "varint":
        out += varint(v)
    elif kind == "kind":
        out.append(MEDIA_KINDS.index(v))
    elif kind == "hash":
        out += bytes.fromhex(v)
    else:
        _put(out, kind, v, number, refs)


def decode(node: str, c: Cursor, pools: dict[str, list[str]]) -> dict:
    """A node read back; unknown flags raise Unknown, an index outside its pool Malformed. Groups may nest to any depth."""
    return _get(node, c, pools, _PLAN[node])


def _get(node: str, c: Cursor, pools: dict[str, list[str]], plan: list) -> dict:
    flags = 0 if node in BARE else c.number(1)
    if flags & ~_KNOWN[node]:
        raise Unknown(f"unknown flags in {node}")
    out: dict = {}
    for name, kind, inner, bit, listed in plan:
        if bit >= 0 and not flags >> bit & 1:
            out[name] = [] if listed else None
        elif inner == "def":
            out[name] = _get_definitions(c, pools)
        elif listed:
            out[name] = [_read(inner, c, pools) for _ in range(_length(c))]
        else:
            out[name] = _read(kind, c, pools)
    if node == "morpheme" and not flags & 1:
        out["kind"] = None
    return out


def _length(c: Cursor) -> int:
    n = c.varint()
    if n > len(c.data) - c.at:
        raise Malformed("a list is longer than the data")
    return n


def _get_definitions(c: Cursor, pools: dict[str, list[str]]) -> list:
    top: list = []
    stack: list[list] = [[_length(c), top]]  # how many are still to come, and where they go
    while stack:
        if not stack[-1][0]:
            stack.pop()
            continue
        stack[-1][0] -= 1
        into, k = stack[-1][1], c.number(1)
        if k > 1:
            raise Unknown(f"definition kind {k}")
        if k:
            group = _get("group", c, pools, _PLAN["group"][:-1])
            group["definitions"] = []
            into.append({"Group": group})
            stack.append([_length(c), group["definitions"]])
        else:
            into.append({"Definition": decode("definition", c, pools)})
    return top


def _read(kind: str, c: Cursor, pools: dict[str, list[str]]) -> object:
    if kind == "str":
        return c.string()
    if kind[0] == "@":
        i = c.number(2)
        if i > len(pools[kind[1:]]):
            raise Malformed(f"index {i} is outside the pool {kind[1:]}")
        return pools[kind[1:]][i - 1] if i else None
    if kind == "varint":
        return c.varint()
    if kind == "kind":
        k = c.number(1)
        if k >= len(MEDIA_KINDS):
            raise Unknown(f"media kind {k}")
        return MEDIA_KINDS[k]
    if kind == "hash":
        return c.take(20).hex()
    return decode(kind, c, pools)


def strings_used(node: str, value: dict) -> list[tuple[str, str]]:
    """(pool, string) of everything a node refers to, in stored order; nothing is left out at any depth."""
    out: list[tuple[str, str]] = []
    _put(bytearray(), node, value, lambda pool, s: out.append((pool, s)) or 0, [])
    return out


def encode_pools(pools: dict[str, list[str]], who: Identity) -> bytes:
    counts = b"".join(struct.pack("<I", len(pools[p]) + 1) for p in POOLS)
    return who.strings + struct.pack("<H", 1) + counts + b"".join(string(s) for p in POOLS for s in pools[p])


def decode_pools(data: bytes, who: Identity) -> dict[str, list[str]]:
    c = Cursor(data)
    if c.take(4) != who.strings or c.number(2) != 1:
        raise Malformed("no string pools of a known version")
    counts = [c.number(4) for _ in POOLS]
    if not all(1 <= n <= 65_536 for n in counts):
        raise Malformed("a pool is too large or has no count")
    return {p: [c.string() for _ in range(n - 1)] for p, n in zip(POOLS, counts)}


def encode_heads(locations: list[tuple[str, int, int, int]], data_blocks: int, who: Identity) -> bytes:
    """The headword index of sorted (headword, block, offset, size)."""
    groups = [locations[i : i + FRONT_BLOCK] for i in range(0, len(locations), FRONT_BLOCK)]
    firsts = [g[0][0].encode() for g in groups]
    if any(len(f) > 65_535 for f in firsts):
        raise Malformed("a headword that starts a block is too long")
    pool_at = 24 + 24 * len(groups)
    body_at = pool_at + sum(map(len, firsts))
    directory, body = [], bytearray()
    for g, first in zip(groups, firsts):
        directory.append(struct.pack("<HHQIQ", len(first), 0, body_at + len(body), len(g), pool_at))
        pool_at += len(first)
        before = b""
        for head, block, offset, size in g:
            raw = head.encode()
            shared = next((i for i, (x, y) in enumerate(zip(before, raw)) if x != y), min(len(before), len(raw)))
            body += varint(shared) + varint(len(raw) - shared) + raw[shared:] + varint(block) + varint(offset) + varint(size)
            before = raw
    header = who.heads + struct.pack("<HHIIII", 1, 0, len(locations), len(groups), data_blocks, 0)
    return header + b"".join(directory) + b"".join(firsts) + bytes(body)


def fold(word: str) -> str:
    """Lower case by single code points."""
    return "".join(c.lower() for c in word)


def sort_key(word: str) -> tuple[bytes, bytes]:
    return fold(word).encode(), word.encode()


class Heads:
    """The headword index, read piece by piece: ``read(at, n)`` gives n bytes of it. Order and bounds are checked as they are read."""

    def __init__(self, read: Callable[[int, int], bytes], size: int, who: Identity) -> None:
        self.read, self.size = read, size
        c = Cursor(read(0, min(24, size)))
        if c.take(4) != who.heads:
            raise Malformed("no headword index")
        version, pad, self.entries, self.groups, self.data_blocks, reserved = struct.unpack("<HHIIII", c.take(20))
        if version != 1 or reserved or pad:
            raise Malformed("no headword index of a known version")
        if self.groups != -(-self.entries // FRONT_BLOCK) or 24 + 24 * self.groups > size:
            raise Malformed("the index has another number of entries than it says")

    def _directory(self, first: int, last: int) -> list[tuple[int, int, int, int]]:
        """(length and place of the first headword, place and number of entries) of the groups first..last-1."""
        data = self.read(24 + 24 * first, 24 * (last - first))
        rows = []
        for i in range(last - first):
            length, pad, at, n, pool = struct.unpack_from("<HHQIQ", data, 24 * i)
            low = 24 + 24 * self.groups
            if pad or not low <= at <= self.size or not low <= pool or pool + length > self.size or not 0 < n <= FRONT_BLOCK:
                raise Malformed("the directory points outside the index")
            rows.append((length, pool, at, n))
        if any(x[2] >= y[2] for x, y in zip(rows, rows[1:])):
            raise Malformed("the directory isn't in order")
        return rows

    def first(self, group: int) -> str:
        length, pool, _, _ = self._directory(group, group + 1)[0]
        try:
            return self.read(pool, length).decode()
        except UnicodeDecodeError as e:
            raise Malformed("a headword isn't UTF-8") from e

    def group_of(self, word: str) -> int | None:
        """The only group that can hold a headword; reads as many entries of the directory as it takes to halve it down."""
        low, high, key = 0, self.groups, sort_key(word)
        while low < high:
            mid = (low + high) // 2
            if sort_key(self.first(mid)) <= key:
                low = mid + 1
            else:
                high = mid
        return low - 1 if low else None

    def rows(self, first: int, last: int) -> Iterator[tuple[int, str, int, int, int]]:
        """(ordinal, headword, block, offset, size) of the groups first..last-1."""
        if first >= last:
            return
        more = min(last + 1, self.groups)
        groups = self._directory(first, more)
        end = groups[last - first][2] if more > last else self.size
        start = groups[0][2]
        c = Cursor(self.read(start, end - start))
        pool = self.read(groups[0][1], max(groups[-1][1] + groups[-1][0] - groups[0][1], 0))
        firsts = [pool[at - groups[0][1] :][:length].decode(errors="replace") for length, at, _, _ in groups]
        upper = sort_key(firsts[-1]) if more > last else None
        before: tuple[bytes, bytes] | None = None
        for g, (_, _, at, n) in enumerate(groups[: last - first]):
            if c.at != at - start:
                raise Malformed("a group doesn't begin where the directory says")
            raw = b""
            for i in range(n):
                shared, rest = c.varint(), c.varint()
                if shared > len(raw):
                    raise Malformed("a headword shares more than there is")
                raw = raw[:shared] + c.take(rest)
                try:
                    word = raw.decode()
                except UnicodeDecodeError as e:
                    raise Malformed("a headword isn't UTF-8") from e
                key = sort_key(word)
                if (before is not None and before >= key) or (upper is not None and key >= upper) or (i == 0 and word != firsts[g]):
                    raise Malformed("the headwords aren't in order")
                before = key
                block = c.varint()
                if block >= max(self.data_blocks, 1):
                    raise Malformed("an entry is in a block that isn't there")
                yield (first + g) * FRONT_BLOCK + i, word, block, c.varint(), c.varint()


def decode_heads(data: bytes, who: Identity) -> tuple[list[tuple[str, int, int, int]], int]:
    """(headword, block, offset, size) in order, and the number of data blocks."""
    h = Heads(lambda at, n: data[at : at + n], len(data), who)
    return [r[1:] for r in h.rows(0, h.groups)], h.data_blocks


def encode_postings(lists: list[tuple[int | str, list[int]]], magic: bytes) -> bytes:
    """An inverted index: keys are tag numbers or texts, ids ascend and are stored as differences."""
    directory, body = bytearray(), bytearray()
    for key, ids in lists:
        name = struct.pack("<HH", key, 0) if isinstance(key, int) else string(key)
        directory += name + struct.pack("<QI", len(body), len(ids))
        for before, i in zip([0, *ids], ids):
            body += varint(i - before)
    return magic + struct.pack("<HHII", 1, 0, len(lists), 0) + bytes(directory) + bytes(body)


def decode_postings(data: bytes, magic: bytes, numbered: bool) -> list[tuple[int | str, list[int]]] | None:
    """The inverted index read back; None if its flags are unknown, which means: scan instead."""
    c = Cursor(data)
    if c.take(4) != magic:
        raise Malformed("no inverted index of this kind")
    version, flags, n, reserved = struct.unpack("<HHII", c.take(12))
    if version != 1 or reserved:
        raise Malformed("no inverted index of a known version")
    if flags:
        return None
    rows = []
    for _ in range(n):
        key: int | str = struct.unpack("<HH", c.take(4))[0] if numbered else c.string()
        rows.append((key, *struct.unpack("<QI", c.take(12))))
    base, out = c.at, []
    for key, at, count in rows:
        b, ids, last = Cursor(data, base + at), [], 0
        for _ in range(count):
            last += b.varint()
            ids.append(last)
        out.append((key, ids))
    return out


def compress(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def decompress(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompressobj().decompress(data)
