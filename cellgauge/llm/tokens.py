"""Token counts of whole texts under a unigram model, on a trie of distinct pre-tokens; byte-pair ids."""

from __future__ import annotations

import json
import math
from array import array
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame

# Nodes of a task's trie and entries of a task's word table, after which it starts anew.
MAX_NODES = 1_500_000
MAX_WORDS = 300_000
WORD_START = "▁"


def zipf_unigram(path: str) -> tuple[dict[str, float], float]:
    """Log probability of each piece of a sentencepiece vocabulary, and that of one byte of a character
    outside it. The file ranks its pieces; a piece of rank r gets weight 1 / (r + 2)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    odd = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    usual = [model.id_to_piece(i) for i in range(n) if not any(is_odd(i) for is_odd in odd)]
    norm = math.log(sum(1 / (r + 2) for r in range(len(usual))))
    return {piece: -math.log(r + 2) - norm for r, piece in enumerate(usual)}, -math.log(len(usual) + 2) - norm


class TokenTrie:
    """Distinct pre-tokens in a trie whose nodes hold the best forward score of their prefix and the number
    of pieces that reach it. A prefix is scored once, however many pre-tokens share it; ``counts`` holds
    the terminal count of each whole pre-token (UTF-8 bytes, without the word-start mark)."""

    def __init__(self, pieces: Mapping[str, float], byte_score: float) -> None:
        self.pieces, self.byte_score = pieces, byte_score
        self.longest = max(map(len, pieces), default=1)
        self.reset()

    def reset(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.pieces_to = [0.0], [0]
        self.counts: dict[bytes, int] = {}

    def insert(self, word: bytes) -> int:
        token = WORD_START + word.decode("utf-8", "replace")
        child, score, reach, known = self.child, self.score, self.pieces_to, self.pieces.get
        path = [0]
        for j, c in enumerate(token, 1):
            at = (path[-1], c)
            node = child.get(at)
            if node is None:
                n_bytes = len(c.encode("utf-8", "replace"))
                best, n = score[path[-1]] + n_bytes * self.byte_score, reach[path[-1]] + n_bytes
                for i in range(max(0, j - self.longest), j):
                    p = known(token[i:j])
                    if p is not None:
                        s, k = score[path[i]] + p, reach[path[i]] + 1
                        if s > best or (s == best and k < n):
                            best, n = s, k
                node = child[at] = len(score)
                score.append(best)
                reach.append(n)
            path.append(node)
        self.counts[word] = reach[path[-1]]
        return reach[path[-1]]

    def count(self, words: Iterable[bytes]) -> int:
        for w in set(words).difference(self.counts):
            self.insert(w)
        return sum(map(self.counts.__getitem__, words))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens for each row of ``docs`` (doc_id, text; others are not looked at).

    Pre-tokens are the words between ASCII white space, each with a word-start mark. n_tokens adds up the
    pieces of their best segmentations under ``zipf_unigram(path)``; of equal scores the one with fewer
    pieces counts; a character outside the vocabulary counts its UTF-8 bytes. Texts are taken whole; the trie
    is a task's own and starts anew beyond a fixed size, which changes no count. No shuffle.

    Null and empty texts: 0 and 0. Repeated rows and null ids: a row each. An empty table gives no rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = TokenTrie(*zipf_unigram(path))
        for batch in batches:
            n_pre, n_tok = [], []
            for text in batch.column(1):
                words = (text.as_py() or "").encode().split()
                n_pre.append(len(words))
                n_tok.append(trie.count(words))
                if len(trie.score) > MAX_NODES or len(trie.counts) > MAX_WORDS:
                    trie.reset()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_pre, pa.int64()), pa.array(n_tok, pa.int64())],
                names=["doc_id", "n_pretokens", "n_tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_pretokens bigint, n_tokens bigint")


class BytePairIds(dict):
    """Little-endian unsigned 32-bit ids of texts in a byte-level BPE vocabulary (a tokenizers JSON file).

    The pre-token pattern always starts a new pre-token at a single blank before other text, so a text
    without runs of blanks is the concatenation of its blank-separated chunks; as a dict, it maps such chunks (without
    their blank) to ids, and is emptied beyond a fixed size."""

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        # Printable bytes stand for themselves, the others for characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = (b for b in range(256) if b not in set(plain))
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocab = {k: v for k, v in file["model"]["vocab"].items() if k not in self.special}
        ranks = {bytes(byte_of[c] for c in k): v for k, v in vocab.items()}
        self.coder = tiktoken.Encoding("ids", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def whole(self, text: str) -> bytes:
        return array("I", self.coder.encode(text, allowed_special="all", disallowed_special=())).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self[chunk] = self.whole(" " + chunk)
        return ids

    def ids(self, text: str) -> bytes:
        if not text or "  " in text or text[0] == " " or text[-1] == " " or any(s in text for s in self.special):
            return self.whole(text)
        if len(self) > MAX_WORDS:
            self.clear()
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, rest))
