"""SentencePiece (BPE) encoding and decoding with a table of each prefix's last token.

In a BPE encoding every prefix of a text has one encoding, hence one last token, and the encoding of a
longer prefix extends the encoding of the prefix before its last token. So a left-to-right pass can
store, for each position, the last token of the prefix that ends there: among the vocabulary pieces that
end there (found by an automaton) it is the one that can stand behind the last token of the prefix
before it. Two tokens can stand side by side exactly if no merge across their border would have come
before the merges that built them. The ids are then read off backwards from the last position.

Spans between spaces are remembered. The new spans of a batch go through the automaton side by side, one
byte of each at a time, so that table look-ups and pair tests are array operations.
"""

from __future__ import annotations

import functools
import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import text_slices, without

SPACE = "▁"
NEVER = 1 << 60
#: Entries kept of each memo in a worker before it starts anew; memory stays bounded.
MEMO_ENTRIES = 500_000
#: Bytes of the spans that go side by side, and how many do; longer ones go one by one.
WIDE, SIDE_BY_SIDE = 64, 32_768
#: Ids that are decoded at once.
DECODED = 1 << 20
#: Slots of the table of pair tests; a pair that finds its slot taken is tested again.
PAIR_SLOTS = 1 << 20


def _automaton(pieces: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(column of each byte, next state, longest piece that ends in each state or 0, next shorter suffix of each piece)."""
    used = sorted({b for p in pieces.values() for b in p})
    column = np.zeros(256, dtype=np.int64)
    column[used] = np.arange(1, len(used) + 1)
    to_column = column.tolist()
    children: list[dict[int, int]] = [{}]
    ends = [0]
    for i, piece in pieces.items():
        at = 0
        for b in piece:
            following = children[at].get(to_column[b])
            if following is None:
                following = children[at][to_column[b]] = len(children)
                children.append({})
                ends.append(0)
            at = following
        ends[at] = i
    step = np.zeros((len(children), len(used) + 1), dtype=np.int32)
    longest, shorter = np.zeros(len(children), dtype=np.int32), np.zeros(max(pieces, default=0) + 1, dtype=np.int32)
    level = [(0, 0)]  # (state, the state of its longest proper suffix), by depth
    while level:
        following = []
        for state, back in level:
            row = step[state]
            if state:
                row[:] = step[back]
            suffix = longest[back] if state else 0
            if ends[state]:
                shorter[ends[state]] = suffix
            longest[state] = ends[state] or suffix
            for c, child in children[state].items():
                following.append((child, int(row[c]) if state else 0))
                row[c] = child
        level = following
    return column, step, longest, shorter


class PieceTable:
    """The vocabulary of one model file as an automaton, split histories and decoding bytes."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.byte_id = {int(pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.id_of = {pieces[i]: i for i in plain}
        steps = {s: k for k, s in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        #: when a piece is formed; single characters are there from the start
        self.born = {i: (steps[model.get_score(i)] if len(pieces[i]) > 1 else -1) for i in plain}
        self.text_of = {i: pieces[i] for i in plain}
        self.unknown_id = model.unk_id()
        self.parts: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            text = pieces[i]
            if len(text) == 1 or self._split(i):
                self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.right = {i: self._spine(i, 1) for i in plain if len(pieces[i]) == 1 or i in self.parts}
        self.left = {i: self._spine(i, 0) for i in self.right}
        self.fits: dict[tuple[int, int], bool] = {}
        # a newline that no piece holds is always a border, which makes the remembered spans shorter
        self.spans = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if any("\n" in p for p in self.id_of) else f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):  # a piece goes on over a space
            self.spans = re.compile("[^\n]+|\n") if not any("\n" in p for p in self.id_of) else re.compile("(?s).+")
        self.surface = [b""] * size
        for i in range(size):
            if model.is_byte(i):
                self.surface[i] = bytes([int(pieces[i][3:5], 16)])
            elif model.is_unknown(i):
                self.surface[i] = " ⁇ ".encode()
            elif not model.is_control(i):
                self.surface[i] = pieces[i].replace(SPACE, " ").encode()
        self.opens = {i for i in plain if pieces[i].startswith(SPACE)}
        self.byte_ids = frozenset(self.byte_id.values())
        # from here on the same as arrays
        raw = {i: self.text_of[i].encode() for i in self.right}
        self.column, self.step, self.longest, self.shorter = _automaton(raw)
        self.bytes_of = np.zeros(size, dtype=np.int64)
        self.bytes_of[list(raw)] = [len(x) for x in raw.values()]
        self.birth, self.inner = np.full(size, -1, dtype=np.int64), np.full((2, size), -1, dtype=np.int64)
        self.birth[list(self.born)] = list(self.born.values())
        if self.parts:
            self.inner[:, list(self.parts)] = np.array(list(self.parts.values())).T
        made = sorted((x * size + y, self.born[i]) for i in plain for k in range(1, len(pieces[i])) if (x := self.id_of.get(pieces[i][:k])) is not None and (y := self.id_of.get(pieces[i][k:])) is not None)
        self.pair_made = np.array([k for k, _ in made] or [-1], dtype=np.int64)
        self.pair_birth = np.array([b for _, b in made] or [NEVER], dtype=np.int64)
        self.size, self.slot_pair, self.slot_fits = size, np.full(PAIR_SLOTS, -1, dtype=np.int64), np.zeros(PAIR_SLOTS, dtype=bool)
        # a text of single spaces is cut at spaces and newlines if no piece reaches over either
        self.newline = self.encode_span("\n") if self.spans.pattern.endswith(f"|\n|[^{SPACE}\n]+") else None
        self.words: dict[str, bytes] = {}
        self.loose: dict[str, bytes] = {}
        self.decoding = pa.array([*self.surface, *[x[1:] if i in self.opens else x for i, x in enumerate(self.surface)]], pa.binary())

    def _split(self, i: int) -> bool:
        """Merge the piece's own characters; true if they end as the piece, whose two last parts are kept."""
        row = list(self.text_of[i])
        while len(row) > 2:
            best = min(((self.born.get(self.id_of.get(a + b, -1), NEVER), k) for k, (a, b) in enumerate(zip(row, row[1:]))), default=(NEVER, 0))
            if best[0] == NEVER:
                return False
            k = best[1]
            row[k : k + 2] = [row[k] + row[k + 1]]
        pair = tuple(self.id_of.get(x, -1) for x in row)
        if len(pair) != 2 or -1 in pair:
            return False
        self.parts[i] = pair
        return True

    def _spine(self, i: int, side: int) -> list[tuple[str, int, int]]:
        """(text, birth, death) of the tokens that stood at this piece's right (1) or left (0) edge."""
        out, death = [], NEVER
        while True:
            out.append((self.text_of[i], self.born[i], death))
            if i not in self.parts:
                return out
            death, i = self.born[i], self.parts[i][side]

    def can_follow(self, a: int, b: int) -> bool:
        """Whether BPE leaves token b right behind token a."""
        found = self.fits.get((a, b))
        if found is None:
            found = True
            for x, x_born, x_dies in self.right[a]:
                for y, y_born, y_dies in self.left[b]:
                    joined = self.id_of.get(x + y)
                    if joined is not None:
                        at = max(self.born[joined], x_born, y_born)
                        # of equal merges the leftmost comes first
                        if at < x_dies and at <= y_dies:
                            found = False
            if len(self.fits) >= MEMO_ENTRIES:
                self.fits.clear()
            self.fits[a, b] = found
        return found

    def encode_span(self, span: str) -> bytes:
        """Ids of one span, as int32 bytes."""
        last = [0] * (len(span) + 1)  # 0: the character before is in no piece
        size = [1] * (len(span) + 1)
        known, can_follow = self.fits.get, self.can_follow
        for end, (token, length) in self.automaton.iter(span):
            end += 1
            if not last[end]:
                before = last[end - length]
                if before:
                    fits = known((before, token))
                    if fits is None:
                        fits = can_follow(before, token)
                    if not fits:
                        continue
                last[end], size[end] = token, length
        ids, at = [], len(span)
        while at:
            if last[at]:
                ids.append(last[at])
                at -= size[at]
            else:
                at -= 1
                if self.byte_id:
                    ids += [self.byte_id[x] for x in reversed(span[at].encode())]
                elif not ids or ids[-1] != self.unknown_id:
                    ids.append(self.unknown_id)
        ids.reverse()
        return struct.pack(f"<{len(ids)}i", *ids)

    def _pairs_fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """can_follow of arrays of pairs."""
        out = np.ones(len(a), dtype=bool)
        rows, x, x_dies = np.arange(len(a)), a, np.full(len(a), NEVER)
        while len(rows):
            inner, y, y_dies = np.arange(len(rows)), b[rows], np.full(len(rows), NEVER)
            while len(inner):
                left = x[inner]
                key = left * self.size + y
                at = np.minimum(np.searchsorted(self.pair_made, key), len(self.pair_made) - 1)
                when = np.maximum(np.maximum(self.pair_birth[at], self.birth[left]), self.birth[y])
                out[rows[inner[(self.pair_made[at] == key) & (when < x_dies[inner]) & (when <= y_dies)]]] = False
                y_dies, y = self.birth[y], self.inner[0, y]
                go = (y >= 0) & out[rows[inner]]
                inner, y, y_dies = inner[go], y[go], y_dies[go]
            x_dies, x = self.birth[x], self.inner[1, x]
            go = (x >= 0) & out[rows]
            rows, x, x_dies = rows[go], x[go], x_dies[go]
        return out

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_pairs_fit by the table of tests made before."""
        key = a * self.size + b
        slot = (key * 0x9E3779B1 >> 12) & (PAIR_SLOTS - 1)
        new = np.flatnonzero(self.slot_pair[slot] != key)
        out = self.slot_fits[slot]
        if len(new):
            _, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            first = new[first]
            fits = self._pairs_fit(a[first], b[first])
            self.slot_pair[slot[first]], self.slot_fits[slot[first]] = key[first], fits
            out[new] = fits[back]
        return out

    def _side_by_side(self, spans: list[bytes], size: np.ndarray) -> list[bytes | None]:
        """Ids of spans, longest first; None where a character is in no piece."""
        n, width = len(spans), int(size[0])
        codes = np.zeros((n, width), dtype=np.int16)
        codes[np.arange(width)[None, :] < size[:, None]] = self.column[np.frombuffer(b"".join(spans), dtype=np.uint8)]
        last, state = np.zeros((n, width + 1), dtype=np.int32), np.zeros(n, dtype=np.int64)
        alive = np.searchsorted(-size, -np.arange(width + 1), side="right")
        for end in range(1, width + 1):
            m = alive[end]
            state = self.step[state[:m], codes[:m, end - 1]]
            token = self.longest[state].astype(np.int64)
            row = np.flatnonzero(token)
            token = token[row]
            while len(row):
                before = last[row, end - self.bytes_of[token]].astype(np.int64)
                fits = before == 0
                ask = np.flatnonzero(~fits)
                fits[ask] = self._fit(before[ask], token[ask])
                last[row[fits], end] = token[fits]
                row, token = row[~fits], self.shorter[token[~fits]].astype(np.int64)
                row, token = row[token > 0], token[token > 0]
        back, count, at, row = np.zeros((n, width), dtype="<i4"), np.zeros(n, dtype=np.int64), size.copy(), np.arange(n)
        bad = np.zeros(n, dtype=bool)
        while len(row):
            token = last[row, at[row]]
            bad[row[token == 0]] = True
            row, token = row[token > 0], token[token > 0]
            back[row, count[row]] = token
            count[row] += 1
            at[row] -= self.bytes_of[token]
            row = row[at[row] > 0]
        place = count[:, None] - 1 - np.arange(width)[None, :]
        flat = np.take_along_axis(back, np.maximum(place, 0), axis=1)[place >= 0].tobytes()
        ends = (4 * np.cumsum(count)).tolist()
        return [None if no else flat[a:b] for a, b, no in zip([0, *ends], ends, bad.tolist())]

    def encode_spans(self, spans: list[str]) -> list[tuple[str, bytes]]:
        """(span, ids as int32 bytes) of each span, longest first."""
        raw = [s.encode() for s in spans]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        order = np.argsort(-size, kind="stable")
        size, at = size[order], order.tolist()
        long = int(np.searchsorted(-size, -WIDE))
        out: list[bytes | None] = [None] * long
        for lo in range(long, len(spans), SIDE_BY_SIDE):
            out += self._side_by_side([raw[k] for k in at[lo : lo + SIDE_BY_SIDE]], size[lo : lo + SIDE_BY_SIDE])
        return [(s, self.encode_span(s) if ids is None else ids) for s, ids in zip([spans[k] for k in at], out)]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids))
        if ids and ids[0] in self.opens:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:  # byte pieces that make no character: each stray byte is U+FFFD
            out, run = [], b""
            for i in [*ids, -1]:
                if i in self.byte_ids:
                    run += self.surface[i]
                    continue
                while run:
                    for n in (1, 2, 3, 4):
                        try:
                            out.append(run[:n].decode())
                            run = run[n:]
                            break
                        except UnicodeDecodeError:
                            if n == 4 or n >= len(run):
                                out.append("�")
                                run = run[1:]
                                break
                if i >= 0:
                    out.append(self.surface[i].decode())
            text = "".join(out)
            return text[1:] if ids[0] in self.opens else text


@functools.lru_cache(maxsize=2)
def load(path: str) -> PieceTable:
    return PieceTable(path)


def encode_texts(path: str, texts: list[str | None]) -> list[bytes]:
    """Ids (int32 bytes) of whole texts; null and empty texts have none."""
    table = load(path)
    for memo in (table.words, table.loose):
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
    rows: list[tuple[dict, list[str]]] = []
    for text in texts:
        if table.newline is not None and text and "  " not in text and SPACE not in text and text[0] != " ":
            rows.append((table.words, text.replace("\n", " \n").split(" ")))
        else:
            rows.append((table.loose, table.spans.findall(SPACE + text.replace(" ", SPACE)) if text else []))
    for memo in (table.words, table.loose):
        new = set().union(*[parts for known, parts in rows if known is memo]).difference(memo)
        if memo is table.loose:
            memo.update(table.encode_spans(list(new)))
            continue
        # a word that begins with a newline stands after it without a space
        after = {w[1:] for w in new if w[:1] == "\n"}
        lines = {"\n" + w: table.newline + ids for w, ids in table.encode_spans(list(after))}
        memo.update((span[1:], ids) for span, ids in table.encode_spans([SPACE + w for w in new if w[:1] != "\n"]))
        memo.update(lines)
    return [b"".join(map(known.__getitem__, parts)) for known, parts in rows]


def encode_text(path: str, text: str | None) -> np.ndarray:
    """Ids of one text; null and empty texts have none."""
    return np.frombuffer(encode_texts(path, [text])[0], dtype="<i4")


def decode_rows(table: PieceTable, rows: pa.ListArray) -> pa.Array:
    """Texts of rows of ids, some rows at a time."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(rows), 0)), dtype=np.int64)
    parts, at = [], 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + DECODED, side="right")))
        parts.append(_decode_rows(table, rows.slice(at, to - at)))
        at = to
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def _decode_rows(table: PieceTable, rows: pa.ListArray) -> pa.Array:
    """Surfaces are taken and joined by Arrow, byte pieces that make no character one by one."""
    ids, ends = np.asarray(rows.flatten()), np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(rows), 0)))])
    begins = ends[:-1][np.diff(ends) > 0]
    at = ids.astype(np.int32)
    at[begins] += table.size  # the surface without the space that opens it
    runs = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), table.decoding.take(pa.array(at)))
    raw = pc.binary_join(runs, pa.scalar(b"", pa.binary()))
    try:
        text = raw.cast(pa.string())
    except pa.ArrowInvalid:
        out = []
        for k, x in enumerate(raw.to_pylist()):
            try:
                out.append(x.decode())
            except UnicodeDecodeError:
                out.append(table.decode(ids[ends[k] : ends[k + 1]].tolist()))
        text = pa.array(out, pa.string())
    return pc.if_else(rows.is_valid(), text, pa.scalar(None, pa.string())) if rows.null_count else text


def encode(text: Column, model_path: str) -> Column:
    """Column of ids (array<int>) of whole texts. Null and empty texts give an empty array."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        rows = [r for part in text_slices(texts) for r in encode_texts(model_path, part.to_pylist())]
        ends = np.zeros(len(rows) + 1, dtype=np.int32)
        np.cumsum([len(r) // 4 for r in rows], out=ends[1:])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), dtype="<i4"), type=pa.int32()))

    return ids(text)


def decode(ids: Column, model_path: str) -> Column:
    """Column of texts from a column of ids. Null gives null, no ids give the empty text."""

    @F.arrow_udf("string")
    def text(rows: pa.Array) -> pa.Array:
        return decode_rows(load(model_path), rows)

    return text(ids)


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """docs with ``ids`` (array<int>) and ``decoded`` (string) added.

    Whole texts are encoded without begin or end ids. Null and empty texts: no ids, decoded ''. Repeated
    rows stay repeated. Columns of docs named ids or decoded are replaced. No shuffle: one pass.
    """
    out = without(docs, *({"ids", "decoded"} - {text_col}))
    out = out.withColumn("ids", encode(F.col(text_col), model_path))
    return out.withColumn("decoded", decode(F.col("ids"), model_path))
