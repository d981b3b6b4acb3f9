"""BERT WordPiece: normalizer, pre-tokenizer and greedy longest match."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Blocks of CJK ideographs that get spaces around them.
CJK = (
    (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F),
    (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F),
)
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0     　") | {chr(c) for c in range(0x2000, 0x200B)}


def is_cjk(c: str) -> bool:
    return any(low <= ord(c) <= high for low, high in CJK)


def is_punctuation(c: str) -> bool:
    return (c.isascii() and c.isprintable() and not c.isalnum() and c != " ") or unicodedata.category(c)[0] == "P"


class WordPiece:
    def __init__(self, vocab, unk_token="[UNK]", prefix="##", most_chars=100, lowercase=True, strip_accents=True, chinese=True, clean=True):
        self.vocab = list(vocab)
        self.ids = {w: i for i, w in enumerate(self.vocab)}
        if unk_token not in self.ids:
            raise ValueError(f"unk token {unk_token} not in vocab")
        self.unk = self.ids[unk_token]
        self.prefix, self.most_chars = prefix, most_chars
        self.lowercase, self.strip_accents, self.chinese, self.clean = lowercase, strip_accents, chinese, clean

    def normalize(self, text: str) -> str:
        out = []
        for c in text:
            if self.clean:
                if c in "\t\n\r":
                    out.append(" ")
                    continue
                if c in "\0�" or unicodedata.category(c)[0] == "C":
                    continue
                if c in WHITE:
                    out.append(" ")
                    continue
            out.append(f" {c} " if self.chinese and is_cjk(c) else c)
        plain = "".join(out)
        if self.strip_accents:
            plain = "".join(c for c in unicodedata.normalize("NFD", plain) if unicodedata.category(c) != "Mn")
        # one code point at a time: a word-final sigma stays an ordinary one
        return "".join(c.lower() for c in plain) if self.lowercase else plain

    def pre_tokenize(self, text: str) -> list[str]:
        out, current = [], []

        def end() -> None:
            if current:
                out.append("".join(current))
                current.clear()

        for c in text:
            if c in WHITE:
                end()
            elif is_punctuation(c):
                end()
                out.append(c)
            else:
                current.append(c)
        end()
        return out

    def pieces(self, word: str) -> list[int]:
        if len(word) > self.most_chars:
            return [self.unk]
        out, start = [], 0
        while start < len(word):
            head = self.prefix if start else ""
            match = next((end for end in range(len(word), start, -1) if head + word[start:end] in self.ids), None)
            if match is None:
                return [self.unk]
            out.append(self.ids[head + word[start:match]])
            start = match
        return out

    def encode(self, text: str) -> list[int]:
        return [i for w in self.pre_tokenize(self.normalize(text)) for i in self.pieces(w)]

    def tokens(self, text: str) -> list[str]:
        return [self.vocab[i] for i in self.encode(text)]


def encode(df: DataFrame, text: str, tokenizer: WordPiece, out: str = "ids") -> DataFrame:
    """``df`` with the token ids of a text column, in Arrow batches."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([tokenizer.encode(t or "") for t in texts])

    return df.withColumn(out, run(F.col(text)))


def normalize(df: DataFrame, text: str, tokenizer: WordPiece, out: str = "normalized") -> DataFrame:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else tokenizer.normalize(t) for t in texts])

    return df.withColumn(out, run(F.col(text)))
