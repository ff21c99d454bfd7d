"""Token counts by byte-pair merging: a heap of adjacent pairs over a linked list of symbols.

``PieceMerger`` reads the pieces and ranks of a piece vocabulary (BPE with byte
fallback). A text's count is the number of its initial symbols less the merges:
the best-ranked adjacent pair (ties: the leftmost) is popped from the heap and
joined in the linked list until no adjacent pair is a piece. A character that
is no piece counts as its UTF-8 bytes. No token identifiers are made.

No piece has a space mark after another character, and none holds a line
break, so merges never cross those places: a text is counted word by word and
repeated words are looked up in a table of bounded size. Both properties are
checked when the vocabulary is read; without them the text is counted whole.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows
and ids are counted row by row; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"  # stands for a space inside pieces
MAX_TABLE = 1_000_000  # words remembered per Python worker, about 120 MB


class PieceMerger:
    """Counts tokens of texts by the pieces of one vocabulary file."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        scores = {}
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
                continue
            if model.is_unused(i):
                raise ValueError(f"piece {i} of {vocabulary} is unused; such vocabularies aren't supported")
            scores[model.id_to_piece(i)] = model.get_score(i)
        if any(c not in scores for p in scores for c in p):
            raise ValueError(f"{vocabulary} has a piece with a character that is no piece itself")
        if model.normalize("a  béé") != "▁a▁▁béé":
            raise ValueError(f"{vocabulary} changes texts before the merges; only a leading space is supported")
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in scores.items()}  # equal scores share a rank
        self.inside = {p[i:i + 2] for p in scores for i in range(len(p) - 1)}
        self.by_word = not any("\n" in p or MARK in p.lstrip(MARK) for p in scores)
        self.known: dict[str, int] = {}

    def merged(self, text: str) -> int:
        """The number of tokens of a text whose spaces are already marks."""
        get, n = self.rank.get, len(text)
        count = n
        for c in text:
            if c not in self.rank:
                count += len(c.encode("utf-8", "surrogatepass")) - 1
        symbol, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
        best = [get(text[i:i + 2], -1) for i in range(n - 1)]  # the rank of the pair that begins at a symbol
        best.append(-1)
        heap = [r * n + i for i, r in enumerate(best) if r >= 0]  # by rank, then from the left
        heapq.heapify(heap)
        while heap:
            r, left = divmod(heapq.heappop(heap), n)
            if best[left] != r:
                continue  # this pair is no longer there
            right = after[left]
            count -= 1
            symbol[left] = piece = symbol[left] + symbol[right]
            best[right] = -1
            after[left] = right = after[right]
            best[left] = -1
            if right < n:
                before[right] = left
                if (r := get(piece + symbol[right], -1)) >= 0:
                    best[left] = r
                    heapq.heappush(heap, r * n + left)
            if (first := before[left]) >= 0:
                best[first] = r = get(symbol[first] + piece, -1)
                if r >= 0:
                    heapq.heappush(heap, r * n + first)
        return count

    def word(self, word: str) -> int:
        """``merged`` of a word, cut where no piece holds the two characters side by side."""
        n = self.known.get(word)
        if n is None:
            if len(self.known) >= MAX_TABLE:
                self.known.clear()
            n, start, inside = 0, 0, self.inside
            for i in range(1, len(word)):
                if word[i - 1:i + 1] not in inside:
                    n += self.part(word[start:i])
                    start = i
            n += self.part(word[start:])
            if len(word) <= 64:
                self.known[word] = n
        return n

    def part(self, part: str) -> int:
        if len(part) == 1:
            return 1 if part in self.rank else len(part.encode("utf-8", "surrogatepass"))
        n = self.known.get(part)
        if n is None:
            n = self.merged(part)
            if len(part) <= 64:
                self.known[part] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if not self.by_word:
            return self.merged(marked)
        total, word = marked.count("\n"), self.word
        for line in marked.split("\n"):
            head, *rest = line.split(MARK)
            if head:
                total += word(head)
            spaces = 0  # a run of marks belongs to the word after it
            for w in rest:
                if w:
                    total += word(MARK * (spaces + 1) + w)
                    spaces = 0
                else:
                    spaces += 1
            if spaces:
                total += word(MARK * spaces)
        return total


@functools.cache
def merger_of(vocabulary: str) -> PieceMerger:
    """One merger, with its table of words, per Python worker."""
    return PieceMerger(vocabulary)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row of ``docs``; ``vocabulary`` is a file that every executor has."""
    ids = docs.select(id_col).schema[id_col]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = merger_of(vocabulary)
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1)]
            tokens = [merger.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                 pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = ids.dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        counted, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
