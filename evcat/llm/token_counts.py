"""Token counts by a linear longest-match automaton.

The pieces of a word are counted without being built. A trie holds the vocabulary; each node
carries a failure link (the node that remains after the pieces matched so far are taken off) and the
number of pieces taken off on that way. A word is read once, byte by byte: on a missing edge the
count of the node is added and its link followed.
"""
from __future__ import annotations

import json
from collections import deque

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from evcat.llm import words as W


def byte_alphabet() -> dict[str, int]:
    """Printable character of each byte in byte-level vocabularies (rule of the public format)."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> list[bytes]:
    """Tokens of a byte-level BPE file as bytes."""
    alphabet = byte_alphabet()
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["model"]["vocab"]
    return [bytes(alphabet[c] for c in token) for token in tokens]


class LongestMatch:
    """Greedy longest-match counter over byte words; every single byte must be in the vocabulary."""

    def __init__(self, vocabulary: list[bytes]):
        edges: dict[int, int] = {}  # node * 256 + byte -> node; the root is 0
        final, parent, label = [False], [0], [0]
        for token in vocabulary:
            node = 0
            for byte in token:
                key = node << 8 | byte
                child = edges.get(key)
                if child is None:
                    child = edges[key] = len(final)
                    final.append(False)
                    parent.append(node)
                    label.append(byte)
                node = child
            if token:
                final[node] = True
        if any(b not in edges or not final[edges[b]] for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes, so some words have no longest match")
        children: dict[int, list[int]] = {}
        for node in range(1, len(final)):
            children.setdefault(parent[node], []).append(node)
        link, popped = [0] * len(final), [0] * len(final)
        queue = deque(children.get(0, ()))
        while queue:
            node = queue.popleft()
            queue.extend(children.get(node, ()))
            if final[node]:
                popped[node] = 1  # the node's own string is one piece, nothing remains
                continue
            at, count = link[parent[node]], popped[parent[node]]
            while (step := edges.get(at << 8 | label[node])) is None:
                count += popped[at]
                at = link[at]
            link[node], popped[node] = step, count
        self.edges, self.link, self.popped = edges, link, popped

    def count(self, word: bytes) -> int:
        edges, link, popped = self.edges, self.link, self.popped
        node = total = 0
        for byte in word:
            while (step := edges.get(node << 8 | byte)) is None:
                total += popped[node]
                node = link[node]
            node = step
        while node:
            total += popped[node]
            node = link[node]
        return total


def count_tokens(text: Column, vocabulary_path: str) -> Column:
    """Struct (n_words, n_tokens) of a text column.

    Words are ``[^\\x20\\x09-\\x0D]+``; each is matched with a blank in front, as byte-level vocabularies
    mark word starts. Null and empty texts have zero of both. Only the text goes to Python; other
    columns, whatever their names, stay where they are.
    """

    def counted(texts: pa.Array) -> pa.Array:
        counts = W.worker_object(
            "token_counts", vocabulary_path,
            lambda: (lambda automaton: W.WordCache(lambda w: automaton.count(b" " + w)))(LongestMatch(load_vocabulary(vocabulary_path))),
        )
        n_words, n_tokens = [], []
        for text in W.utf8(texts):
            words = W.blank_words(text)
            n_words.append(len(words))
            n_tokens.append(sum(map(counts.__getitem__, words)))
        return W.struct_array({"n_words": (n_words, pa.int64()), "n_tokens": (n_tokens, pa.int64())})

    return F.arrow_udf(counted, "n_words bigint, n_tokens bigint")(text)
