"""SentencePiece encoding and decoding of merge-type (BPE) models, exactly, by backtracking.

A text is cut where a piece can never span: before a ``▁`` that follows something else, and before
signs at the end of a word if no piece holds the two neighbours of the cut. Each such chunk is
encoded alone. One pass of an Aho-Corasick automaton over a chunk gives the longest piece that
matches at each place, a table the next shorter one that it begins with. A piece may follow
another if the merge rules, run on the two together, give just these two back. Encoding takes the
longest compatible piece and steps back where none fits; a bit per place remembers those from
which no encoding exists. The chunks of a batch are found by Arrow, each once, and as chunks
repeat, every worker keeps the ids of the last ones in two tables of bounded size.

Nulls count as empty texts; an empty text has no ids and decodes to an empty text. Repeated rows
are encoded each, an empty table gives none. A text is held whole by one task.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

MARK = "▁"
CHUNKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
KEPT_CHUNKS = 400_000  # entries of each of the two tables of chunks that a worker keeps
KEPT_PAIRS = 400_000
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
RESULT = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


class Model:
    """The pieces of a model file with the rules to encode a chunk and to decode ids."""

    def __init__(self, serialized: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=serialized)
        n = sp.get_piece_size()
        kinds = [(sp.is_byte(i), sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
                 for i in range(n)]
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.unknown = sp.unk_id()
        self.ids = {pieces[i]: i for i in range(n) if kinds[i] == (False, False)}
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.plain = "\n" not in self.ids
        self.bytes = {int(pieces[i][3:5], 16): i for i in range(n) if kinds[i][0]}
        self._check(sp)
        self.surface = [b""] * n
        for i in range(n):
            if kinds[i][0]:
                self.surface[i] = bytes([int(pieces[i][3:5], 16)])
            elif not kinds[i][1]:
                self.surface[i] = pieces[i].replace(MARK, " ").encode()
        self.surface[self.unknown] = " ⁇ ".encode()
        # A piece whose own merges do not give it back never occurs. The last merge of each
        # other piece is kept, and those whose merges do not come in order of rank are marked.
        self.last: dict[str, tuple[str, str]] = {}
        self.words = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) == 1 or self.merged(piece, 0, self.last) == [piece]:
                self.words.add_word(piece, len(piece))
        self.words.make_automaton()
        self.shorter = {}  # of each piece the longest other one that it begins with, else ""
        for piece in self.words:
            k = len(piece) - 1
            while k and piece[:k] not in self.words:
                k -= 1
            self.shorter[piece] = piece[:k]
        self.widest = max(map(len, self.shorter), default=1)
        self.odd = set()
        for piece in sorted(self.last, key=len):
            if any(part in self.odd or self.made(part) >= self.rank[piece]
                   for part in self.last[piece]):
                self.odd.add(piece)
        self.pairs: dict[str, dict[str, bool]] = {}  # by first piece, then by second
        self.n_pairs = 0
        self.together = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.surfaces = pa.array(self.surface, pa.binary())
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def made(self, piece: str) -> float:
        """The rank of the merge that made a piece; characters are there from the start."""
        return self.rank[piece] if len(piece) > 1 else -math.inf

    def _check(self, sp) -> None:
        """Refuse models whose rules are not the ones written here."""
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece spans two words")
        if {c for p in self.ids for c in p} - set(self.ids):
            raise ValueError("a character of a piece is no piece")
        probe = "Ab  é ｆ\t\n c "
        if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("the model changes its texts before it encodes them")

    def merged(self, text: str, cut: int, last: dict | None = None) -> list[str]:
        """What the merge rules make of a text: the best pair first, the leftmost of equals.

        Stops once something has grown across ``cut``; notes in ``last`` what made a whole text.
        """
        parts = list(text)
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []

        def push(i: int, j: int) -> None:
            rank = self.rank.get(parts[i] + parts[j])
            if rank is not None:
                heapq.heappush(queue, (rank, i, j, len(parts[i]) + len(parts[j])))

        for i in range(n - 1):
            push(i, i + 1)
        while queue:
            _, i, j, size = heapq.heappop(queue)
            if not parts[i] or not parts[j] or len(parts[i]) + len(parts[j]) != size \
                    or right[i] != j:
                continue
            if last is not None and len(parts[i]) + len(parts[j]) == n:
                last[text] = (parts[i], parts[j])
            parts[i] += parts[j]
            parts[j] = ""
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
                push(i, right[i])
            if left[i] >= 0:
                push(left[i], i)
            if cut and i < cut < i + len(parts[i]):
                break  # the two have grown together
        return [p for p in parts if p]

    def fits(self, first: str, second: str) -> bool:
        """Whether the merge rules leave two neighbouring pieces as they are."""
        after = self.pairs.setdefault(first, {})
        known = after.get(second)
        if known is None:
            if first in self.odd or second in self.odd:
                known = self.merged(first + second, len(first)) == [first, second]
            else:
                known = self.apart(first, second)
            after[second] = known
            self.n_pairs += 1
        return known

    def apart(self, x: str, y: str) -> bool:
        """Takes the merges of both back, the latest first: at no time may the parts that meet
        at the border have a merge of their own that comes before the one taken back."""
        limit, right = math.inf, False
        while True:
            rank = self.rank.get(x + y)
            if rank is not None and (rank < limit or right and rank == limit):
                return False
            made_x, made_y = self.made(x), self.made(y)
            if made_x > made_y:
                limit, right, x = made_x, False, self.last[x][1]
            elif made_y > -math.inf:  # of equal merges the left one came first
                limit, right, y = made_y, True, self.last[y][0]
            else:
                return True

    def split(self, chunk: str) -> list[str]:
        """The pieces of a chunk; a character that is no piece stands for itself."""
        n = len(chunk)
        longest = [0] * n
        for end, size in self.words.iter(chunk):  # of one place the longer matches come later
            longest[end - size + 1] = size
        failed, any_failed = bytearray(n // 8 + 1), False  # a bit per place without encoding
        if self.n_pairs > KEPT_PAIRS:
            self.pairs.clear()
            self.n_pairs = 0
        shorter, pairs, after = self.shorter, self.pairs, {}
        out: list[str] = []
        stack: list[str] = []  # for each piece the match to try next in its place
        pos, before = 0, None
        piece = chunk[:longest[0]] if n else ""
        while pos < n:
            if not longest[pos]:  # an unknown character: nothing merges with it
                out.append(chunk[pos])
                stack.append("")
                pos += 1
                before, piece = None, chunk[pos:pos + longest[pos]] if pos < n else ""
                continue
            while piece:
                fit = before is None or after.get(piece)
                if fit is None:
                    fit = self.fits(before, piece)
                if fit:
                    end = pos + len(piece)
                    if not any_failed or not failed[end >> 3] >> (end & 7) & 1:
                        out.append(piece)
                        stack.append(shorter[piece])
                        before, pos = piece, end
                        after = pairs.get(piece)
                        if after is None:
                            after = pairs[piece] = {}
                        piece = chunk[end:end + longest[end]] if end < n else ""
                        break
                piece = shorter[piece]
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                any_failed = True
                pos -= len(out.pop())
                piece = stack.pop()
                before = out[-1] if out and out[-1] in shorter else None
                after = pairs.setdefault(before, {}) if before else {}
        return out

    def encoded(self, chunk: str) -> bytes:
        """The ids of a chunk as packed 32-bit numbers."""
        pieces = self.split(chunk)
        try:
            return array("i", map(self.ids.__getitem__, pieces)).tobytes()
        except KeyError:  # characters that are no piece
            ids: list[int] = []
            for piece in pieces:
                if piece in self.ids:
                    ids.append(self.ids[piece])
                elif self.bytes:
                    ids.extend(self.bytes[b] for b in piece.encode())
                else:
                    ids.append(self.unknown)
            return array("i", ids).tobytes()

    def known(self, chunks: list[str]) -> list[bytes]:
        """The packed ids of different chunks; those used of late are kept. A chunk without
        ``▁`` or a line feed in front follows a blank."""
        if len(self.chunks) > KEPT_CHUNKS:
            self.older, self.chunks = self.chunks, {}
        table = self.chunks
        found = list(map(table.get, chunks))
        for k in [k for k, ids in enumerate(found) if ids is None]:
            chunk = chunks[k]
            ids = self.older.get(chunk)
            if ids is None:
                first = chunk[:1]
                whole = chunk if first == "\n" or first == MARK else MARK + chunk
                word = whole.rstrip(SIGNS)
                cut = len(word)
                if 1 < cut < len(whole) and whole[cut - 1:cut + 1] not in self.together:
                    ids = self._alone(word) + self._alone(whole[cut:])
                else:
                    ids = self.encoded(whole)
            table[chunk] = found[k] = ids
        return found

    def _alone(self, part: str) -> bytes:
        """A part that nothing next to it merges with; it may be a chunk of its own, too."""
        key = part[1:] if part[:1] == MARK and part[1:2] not in ("", MARK, "\n") else "\0" + part
        ids = self.chunks.get(key) or self.older.get(key)
        if ids is None:
            ids = self.encoded(part)
        self.chunks[key] = ids
        return ids

    def chunked(self, texts: pa.Array) -> pa.ListArray:
        """The chunks of each text; mostly words, told apart by single blanks, as in ``known``."""
        def split(plain: pa.Array) -> pa.ListArray:
            return pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")

        odd = pc.or_(pc.or_(pc.match_substring(texts, MARK), pc.match_substring(texts, "  ")),
                     pc.or_(pc.starts_with(texts, " "), pc.equal(pc.binary_length(texts), 0)))
        if self.plain and not pc.any(odd).as_py():
            return split(texts)
        mask = odd.to_numpy(zero_copy_only=False) if self.plain else np.ones(len(texts), bool)
        lists = pa.array([CHUNKS.findall(MARK + t.replace(" ", MARK)) if t else []
                          for t in texts.filter(pa.array(mask)).to_pylist()],
                         pa.list_(pa.string()))
        both = pa.concat_arrays([split(texts.filter(pa.array(~mask))), lists])
        return both.take(pa.array(np.argsort(np.argsort(mask, kind="stable"))))

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the end of each text in them."""
        cut = self.chunked(pc.fill_null(texts, ""))
        chunks = cut.flatten().dictionary_encode()
        found = self.known(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())
        which = chunks.indices.to_numpy()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        own = sizes[which]
        ends = np.concatenate([[0], np.cumsum(own)])
        begin = (np.cumsum(sizes) - sizes)[which] - ends[:-1]
        ids = np.frombuffer(b"".join(found), np.int32)[np.repeat(begin, own) + np.arange(ends[-1])]
        return ids, ends[cut.offsets.to_numpy()[1:] - cut.offsets[0].as_py()]

    def encode(self, text: str | None) -> bytes:
        return self.encode_texts(pa.array([text], pa.string()))[0].tobytes()

    def decode_texts(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        joined = pc.binary_join(pa.ListArray.from_arrays(
            offsets, self.surfaces.take(pa.array(ids))), b"")
        joined = pc.if_else(pc.starts_with(joined, b" "),
                            pc.binary_replace_slice(joined, 0, 1, b""), joined)
        try:
            return joined.cast(pa.string())
        except pa.ArrowInvalid:  # bytes of the model that are no character
            return pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()])

    def decode(self, ids: list[int]) -> str:
        return self.decode_texts(np.array(ids, np.int32), np.array([len(ids)]))[0].as_py()


def read_model(path: str) -> Model:
    """The model, read once on the driver; its few megabytes are sent to every worker once."""
    with open(path, "rb") as file:
        return Model(file.read())


def encode_decode(texts: Column, model: Broadcast) -> Column:
    """A struct of the ``ids`` of a text and the text ``decoded`` from them."""

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rules = model.value
        for batch in batches:
            parts = []
            for at in range(0, len(batch), 1000):  # whole texts, a few at a time
                ids, ends = rules.encode_texts(batch.slice(at, 1000))
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                parts.append(pa.StructArray.from_arrays(
                    [lists, rules.decode_texts(ids, ends)], ["ids", "decoded"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], RESULT)

    return run(texts)


def with_pieces(docs: DataFrame, model_path: str, text: str = "text",
                into: str = "pieces") -> DataFrame:
    """Adds a struct column ``into`` (``ids``, ``decoded``) for every whole text."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    return docs.withColumn(into, encode_decode(F.col(text), model))


def digests(encoded: Column) -> list[Column]:
    """Count and digests of what ``with_pieces`` added."""
    ids, decoded = encoded["ids"], encoded["decoded"]
    return [F.size(ids).cast("long").alias("n_tokens"),
            F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256)
            .alias("ids_sha256"),
            F.sha2(decoded.cast("binary"), 256).alias("decoded_sha256")]
