"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie over word starts and a second one over continuations. Where the trie has no next letter, a failure link leads
to where matching goes on after the longest pieces are taken off, with the number of pieces popped on the way counted beforehand.
So each letter is read once: the count of pieces follows without building any piece.

Defined results: null and empty texts have no words and no tokens; a word that the vocabulary cannot cover, or of more than
`max_word` letters where that is given, is one unknown token; repeated rows count each by itself; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import utf8

#: Words whose counts a worker remembers.
CACHE_WORDS = 500_000
#: The mark that a vocabulary of word-initial pieces puts before them.
INITIAL = "▁"


class Automaton:
    """Counts of greedy longest-match pieces. heads: pieces that begin a word; tails: pieces that continue one."""

    def __init__(self, heads: set[str], tails: set[str]):
        # States: 0 is the heads' root, 1 the tails' root; state 1 with no letter left means that all letters are taken off.
        self.next: list[dict[str, int]] = [{}, {}]
        piece = [False, False]
        depth = [0, 0]
        for root, vocabulary in ((0, heads), (1, tails)):
            for word in vocabulary:
                at = root
                for letter in word:
                    to = self.next[at].get(letter)
                    if to is None:
                        to = self.next[at][letter] = len(self.next)
                        self.next.append({})
                        piece.append(False)
                        depth.append(depth[at] + 1)
                    at = to
                piece[at] = bool(word) or piece[at]
        n = len(self.next)
        #: Where matching goes on, and how many pieces are taken off on the way; -1: nowhere, the word is unknown.
        self.fail, self.popped = [-1] * n, [0] * n
        todo = deque([0, 1])
        while todo:  # by depth: a state's link follows from its parent's
            at = todo.popleft()
            for letter, to in self.next[at].items():
                todo.append(to)
                if piece[to]:
                    self.fail[to], self.popped[to] = 1, 1
                    continue
                link, count = self.fail[at], self.popped[at]
                while link != -1 and letter not in self.next[link]:
                    count += self.popped[link]
                    link = self.fail[link]
                if link != -1:
                    self.fail[to], self.popped[to] = self.next[link][letter], count
        # A state whose letters are a piece pops it as a whole at the word's end, whatever its longer children do.

    def count(self, word: str) -> int:
        """Number of pieces; -1 if greedy matching finds no way through the word."""
        next_, fail, popped = self.next, self.fail, self.popped
        at, total = 0, 0
        for letter in word:
            while (to := next_[at].get(letter)) is None:
                total += popped[at]
                at = fail[at]
                if at == -1:
                    return -1
            at = to
        while at != 1:
            if (to := fail[at]) == -1:
                return -1
            total += popped[at]
            at = to
        return total


def greedy_count(word: str, heads: set[str], tails: set[str]) -> int:
    """The plain definition: the longest piece again and again; -1 if there is none."""
    at, total = 0, 0
    while at < len(word):
        pieces = tails if at else heads
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return -1
        at, total = end, total + 1
    return total


def piece_vocabulary(model_path: str | None = None) -> tuple[set[str], set[str]]:
    """Head and tail pieces of a sentence-piece vocabulary: with the word mark, and without. Control and byte pieces are left out."""
    import sentencepiece

    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    heads = {x[1:] for x in names if x.startswith(INITIAL) and INITIAL not in x[1:] and len(x) > 1}
    return heads, {x for x in names if INITIAL not in x}


_WORKER: dict[str, tuple[Automaton, dict[bytes, int]]] = {}


def token_counts(docs: DataFrame, heads: set[str] | None = None, tails: set[str] | None = None, id_col: str = "doc_id", text_col: str = "text", max_word: int | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_tokens (an unknown word is one), n_unknown. Words are what stands between ASCII white space."""
    if heads is None or tails is None:
        heads, tails = piece_vocabulary()
    shared = docs.sparkSession.sparkContext.broadcast((sorted(heads), sorted(tails)))  # the vocabulary, whatever the table's size
    key = uuid.uuid4().hex

    def run(batches):
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = (Automaton(*map(set, shared.value)), {})
        automaton, known = _WORKER[key]

        def look(word: bytes) -> int:
            text = word.decode()
            n = automaton.count(text) if max_word is None or len(text) <= max_word else -1
            if len(word) <= 64:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                known[word] = n
            return n

        for batch in batches:
            words, tokens, unknown = [], [], []
            for text in batch.column(1):
                parts = text.as_py().split()
                counts = [known[w] if w in known else look(w) for w in parts]
                missed = counts.count(-1)
                words.append(len(parts))
                tokens.append(sum(counts) + 2 * missed)
                unknown.append(missed)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (words, tokens, unknown))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
