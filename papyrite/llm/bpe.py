"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece the table stores the one last token with which the BPE encoding of that
prefix ends. A list of tokens is a BPE encoding exactly if each two neighbours are the BPE encoding of their
joined bytes, so the last token at position ``i`` is the one vocabulary entry ending at ``i`` that goes with
the last token stored where it begins. Appending bytes only adds rows to the table; after an edit the rows
before it stay and the rows behind it are reused as soon as they agree again over the longest token.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrite.llm.shared import held, small

#: Pieces that a Python worker remembers before it starts afresh; of those before, the ones that come again are taken over.
MEMO = 200_000
#: Patterns whose matches, between characters that are not white space, always end before a single blank and before
#: and after a single line end.
SPLITS_AT_BLANKS = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",)
#: Pairs of tokens of which a worker remembers whether they may stand side by side.
PAIRS = 500_000


def load_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Ranks from a file of lines ``base64 rank``."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """Tokens by bytes and by id, and which of them may follow one another."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the ranks lack single bytes: {missing[:5]}")
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.ends = {token[i:] for token in ranks for i in range(len(token))}
        self._edges: dict[int, tuple[list[int], list[int]]] = {}
        self._fits: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes, below: int = 1 << 60) -> list[int]:
        """Plain BPE: join the pair of lowest rank (under ``below``), leftmost first, until none is left. Slow; defines the result."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (-1: the beginning) in an encoding."""
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            known = self._fits[left, right] = self.merge(self.token[right]) == [right] if left < 0 else self._apart(left, right)
        return known

    def edges(self, token: int) -> tuple[list[int], list[int]]:
        """The tokens that stand at the left and at the right end of ``token`` while it is put together, first to last."""
        known = self._edges.get(token)
        if known is None:
            data = self.token[token]
            lefts, rights = ([token], [token]) if len(data) == 1 else ([], [])
            if len(data) > 1:
                # the last join made the token of two parts: the encoding without the token itself
                left, right = self.merge(data, below=token)
                lefts, rights = self.edges(left)[0] + [token], self.edges(right)[1] + [token]
            known = self._edges[token] = (lefts, rights)
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Whether no join crosses the border while both tokens grow towards it, lowest rank first."""
        ranks, token, never = self.ranks, self.token, 1 << 60
        lefts, rights = self.edges(left)[1], self.edges(right)[0]
        i = j = 0
        while True:
            grow_left = lefts[i + 1] if i + 1 < len(lefts) else never
            grow_right = rights[j + 1] if j + 1 < len(rights) else never
            across = ranks.get(token[lefts[i]] + token[rights[j]], never)
            if across < grow_left and across <= grow_right:  # of equal ranks the leftmost goes first
                return False
            if grow_left == grow_right == never:
                return True
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1


class PrefixTable:
    """The last token of each prefix of some bytes; supports exact appends, cuts and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self._extend(len(self.data))

    def cut(self, length: int) -> None:
        self.data = self.data[:length]
        del self.last[length + 1 :]

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in the place of ``data[start:end]``; returns how many rows were computed."""
        old, old_data, shift = self.last, self.data, len(new) - (end - start)
        self.data = old_data[:start] + new + old_data[end:]
        self.last = old[: start + 1]
        agreed = done = 0
        for at in range(start + 1, len(self.data) + 1):
            if agreed >= self.vocabulary.longest:  # every later row looks back at agreeing rows only
                self.last.extend(old[at - shift :])
                break
            self._extend(at)
            done += 1
            behind = at - start - len(new)
            agreed = agreed + 1 if behind >= 0 and self.last[at] == old[at - shift] else 0
        return done

    def _extend(self, until: int) -> None:
        """Add the rows up to ``until``."""
        vocabulary, data, last = self.vocabulary, self.data, self.last
        get, ends, fits = vocabulary.ranks.get, vocabulary.ends, vocabulary._fits
        for end in range(len(last), until + 1):
            ending = []
            for begin in range(end - 1, -1, -1):
                tail = data[begin:end]
                token = get(tail)
                if token is not None:
                    ending.append((last[begin], token))
                elif tail not in ends:
                    break
            for pair in reversed(ending):  # the longest fits most often
                fit = fits.get(pair)
                if fit or fit is None and vocabulary.fits(*pair):
                    last.append(pair[1])
                    break
            else:
                raise AssertionError("every prefix has an encoding")

    def ids(self) -> list[int]:
        found, at = [], len(self.data)
        while at:
            token = self.last[at]
            found.append(token)
            at -= len(self.vocabulary.token[token])
        return found[::-1]


class Tokenizer:
    """Splits texts by a pattern and encodes each piece by itself, remembering pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.vocabulary = Vocabulary(ranks)
        self.pieces = regex.compile(pattern).findall
        self._splits = pattern in SPLITS_AT_BLANKS
        self._odd = re.compile("[\x00\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|[ \n][ \n]").search
        self._memo: dict[str, tuple[int, ...]] = {"": ()}
        self._chunks: dict[str, tuple[int, ...]] = {"": ()}
        self._memo_before: dict[str, tuple[int, ...]] = {}
        self._chunks_before: dict[str, tuple[int, ...]] = {}

    def chunks(self, text: str) -> list[str]:
        """Parts of the text between which the pattern always ends a match: single blanks and single line ends among
        other characters. The whole text where white space is of another kind or stands together."""
        if not self._splits or self._odd(text):
            return [text]
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode the pieces in sorted order, so that each reuses the rows of the prefix it shares with the one before."""
        table = PrefixTable(self.vocabulary)
        for data, piece in sorted((p.encode("utf-8", "surrogatepass"), p) for p in pieces):
            whole = self.vocabulary.ranks.get(data)
            if whole is not None and self.vocabulary.fits(-1, whole):
                self._memo[piece] = (whole,)
                continue
            shared, limit = 0, min(len(data), len(table.data))
            while shared < limit and data[shared] == table.data[shared]:
                shared += 1
            table.cut(shared)
            table.append(data[shared:])
            self._memo[piece] = tuple(table.ids())

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        if len(self._memo) > MEMO:
            self._memo_before, self._memo = self._memo, {"": ()}
        if len(self._chunks) > MEMO:
            self._chunks_before, self._chunks = self._chunks, {"": ()}
        memo, known = self._memo, self._chunks
        split = [self.chunks(text) for text in texts]
        wanted = set(chain.from_iterable(split)).difference(known)
        known |= {chunk: self._chunks_before[chunk] for chunk in wanted.intersection(self._chunks_before)}
        fresh = {chunk: self.pieces(chunk) for chunk in wanted.difference(known)}
        missing = set(chain.from_iterable(fresh.values())).difference(memo)
        memo |= {piece: self._memo_before[piece] for piece in missing.intersection(self._memo_before)}
        self.learn(missing.difference(memo))
        for chunk, pieces in fresh.items():
            known[chunk] = memo[pieces[0]] if len(pieces) == 1 else tuple(chain.from_iterable(map(memo.__getitem__, pieces)))
        for chunks in split:
            yield list(chain.from_iterable(map(known.__getitem__, chunks)))
        for chunk in fresh:
            if len(chunk) > 60:
                del known[chunk]

    def encode(self, text: str) -> list[int]:
        return next(self.encode_batch([text]))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.token.__getitem__, ids))


def _tokenizer(ranks_file: bytes, pattern: str) -> Tokenizer:
    """One tokenizer for each Python worker, kept from task to task."""
    key = hashlib.sha256(ranks_file + pattern.encode()).hexdigest()
    return held("bpe" + key, lambda: Tokenizer(load_ranks(ranks_file.splitlines()), pattern))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns ``id_col, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids`` (array<int>) - one row per
    input row, in no order. Null texts count as empty: no tokens, digests of the empty string. Repeated rows give
    repeated rows, null ids stay null; other columns of ``docs`` are not read. The ranks file (under 1 MB) is read on
    the driver and goes to the workers as a broadcast.
    """
    with open(ranks_path, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        tokenizer = _tokenizer(ranks.value, pattern)
        text_of = {rank: str(rank) for rank in tokenizer.vocabulary.token}
        for batch in small(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts, hashed, decoded, lists = [], [], [], []
            for ids in tokenizer.encode_batch(texts):
                counts.append(len(ids))
                hashed.append(hashlib.sha256(" ".join(map(text_of.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(tokenizer.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashed, pa.string()), pa.array(decoded, pa.string())]
            fields = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                fields.append("ids")
            yield pa.RecordBatch.from_arrays(columns, fields)

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
