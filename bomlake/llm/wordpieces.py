"""Token counts by a linear longest-match automaton.

Greedy longest-match word pieces are counted without building them. Two tries hold the vocabulary, one for
pieces that start a word and one for pieces that continue it. Each node has a failure link, where the match
goes on when no child fits, and the number of pieces that are complete by then, both computed once; so each
character of a word costs amortised constant time.

Words are runs of characters other than Unicode white space. With `spelled`, a word that no marked piece starts begins
with the bare mark, and a character without a piece is its bytes' pieces, so only a model that lacks these has unknown
words. Without it, a word that the pieces can't spell so is one unknown token.
Defined results: null, empty and blank texts have no words; rows that repeat are counted one by one; other
columns don't matter.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare, worker_state

#: Words whose counts a worker remembers.
REMEMBERED = 500_000
MARK = "▁"


class Automaton(dict):
    """word -> number of its pieces, 0 for an unknown word; remembers short words."""

    def __init__(self, starts, continues, bare=False, octets=frozenset()):
        """bare: the mark alone is a piece; octets: bytes that have a piece."""
        super().__init__()
        self.octets = octets if bare else frozenset()
        self.children: list[dict[str, int]] = [{}, {}]  # 0: root of starts, 1: of continuations
        self.fail: list[int] = [-1, -1]
        self.popped: list[int] = [0, 0]
        if bare:  # an empty start
            self.fail[0], self.popped[0] = 1, 1
        whole = {}
        for root, pieces in ((0, starts), (1, continues)):
            for piece in pieces:
                node = root
                for c in piece:
                    node = self.children[node].setdefault(c, len(self.children))
                    if node == len(self.children):
                        self.children.append({}), self.fail.append(-1), self.popped.append(0)
                if piece:
                    whole[node] = 1
        if bare:  # characters of pieces that are none themselves are spelt in bytes
            for c in {c for piece in (*starts, *continues) for c in piece}:
                node = self.children[1].setdefault(c, len(self.children))
                if node == len(self.children):
                    self.children.append({}), self.fail.append(-1), self.popped.append(0)
                if node not in whole and octets.issuperset(c.encode("utf-8", "surrogatepass")):
                    whole[node] = len(c.encode("utf-8", "surrogatepass"))
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for c, node in self.children[parent].items():
                queue.append(node)
                if node in whole:
                    self.fail[node], self.popped[node] = 1, whole[node]
                    continue
                at, n = self.fail[parent], self.popped[parent]
                while at >= 0 and c not in self.children[at]:
                    n += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.children[at][c], n

    def count(self, word: str) -> int:
        children, fail, popped = self.children, self.fail, self.popped
        node, n = 0, 0
        for c in word:
            while node >= 0 and c not in children[node]:
                last = node
                n += popped[node]
                node = fail[node]
            if node < 0:
                if last != 1:
                    return 0
                # no piece has the character
                spelt = c.encode("utf-8", "surrogatepass")
                if not self.octets.issuperset(spelt):
                    return 0
                n, node = n + len(spelt), 1
            else:
                node = children[node][c]
        while node > 1:
            n += popped[node]
            node = fail[node]
        return n if node == 1 else 0

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


def vocabulary(model: str) -> tuple[list[str], list[str]]:
    """Pieces of a SentencePiece file that start a word, without their mark, and that continue one."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [p[1:] for p in plain if p[0] == MARK and MARK not in p[1:] and p != MARK], [p for p in plain if MARK not in p]


def spelling(model: str) -> tuple[list[str], list[str], bool, frozenset[int]]:
    """Pieces of a SentencePiece file that start a word, without their mark, all pieces, whether the bare mark is one, and the bytes that have one."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = range(sp.get_piece_size())
    plain = [sp.id_to_piece(i) for i in n if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [p[1:] for p in plain if p[0] == MARK and p != MARK], plain, MARK in plain, frozenset(int(sp.id_to_piece(i)[3:-1], 16) for i in n if sp.is_byte(i))


def counts(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id", spelled: bool = False) -> DataFrame:
    """key, n_words, n_tokens, n_unknown for every row. Nothing is shuffled."""
    prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def work(batches):
        automaton = worker_state("wordpieces", f"pieces:{spelled}:{model}", lambda: Automaton(*(spelling if spelled else vocabulary)(model)))
        for batch in batches:
            words, tokens, unknown = [], [], []
            for value in batch.column(1):
                split = (value.as_py() or "").split()
                each = np.fromiter(map(automaton.__getitem__, split), np.int64, len(split))
                words.append(len(split)), unknown.append(int((each == 0).sum())), tokens.append(int(each.sum()) + unknown[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))], names=[key, "n_words", "n_tokens", "n_unknown"])

    return docs.select(docs[key], docs[text].cast("string")).mapInArrow(work, f"`{key}` {kind}, n_words bigint, n_tokens bigint, n_unknown bigint")
