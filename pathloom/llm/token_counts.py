"""Token counts without ids: pieces are counted once per distinct pre-token and joined to the documents' pre-token
frequencies.

A text is cut into stretches (a run of white space and the word behind it; a pre-token of byte-level BPE never crosses
from a word into the white space behind it). The distinct stretches of a block of documents are split by the library's
own pre-tokenizer, which gives the documents' pre-token frequencies as an inverted index. The index is then sorted by pre-token, over all documents; each distinct one's pieces
are counted once, the count joined to its frequencies, and the products summed by document.
Texts that hold the string of an added token are counted by the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm._common import memo, text_of
from pathloom.llm.postings import Numbers, postings, sums

#: Unicode's White_Space, as the pre-tokenizer understands it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
STRETCH = f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"
#: A stretch that is one pre-token, whatever the version of Unicode: a blank, if any, and letters.
PLAIN = re.compile(" ?[A-Za-z]+").fullmatch


class PieceCounter:
    """Counts of a byte-level BPE tokenizer whose pre-tokens end where white space begins."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.normalizer, self.pre, self.model = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer, self.tokenizer.model
        if self.normalizer is not None:
            raise ValueError(f"{path} normalizes texts")
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.stretches = re.compile(STRETCH).findall

    def pre_tokens(self, stretch: str) -> list[str]:
        """As the library writes them: a sign for each byte."""
        if PLAIN(stretch):
            return [stretch.replace(" ", "Ġ")]
        return [p for p, _ in self.pre.pre_tokenize_str(stretch)]

    def pieces(self, pre_token: str) -> int:
        return len(self.model.tokenize(pre_token))

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def split(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """For postings(): texts with added tokens have no pre-tokens, and their count besides."""
        stretches = Numbers()
        runs, often, besides = [], [], []
        for t in texts:
            odd = self.added is not None and self.added.search(t)
            besides.append(self.whole(t) if odd else 0)
            found = [] if odd else self.stretches(t)
            run, n = np.unique(np.fromiter(map(stretches.__getitem__, found), dtype=np.int32, count=len(found)), return_counts=True)
            runs.append(run), often.append(n.astype(np.int32))
        text = np.repeat(np.arange(len(texts), dtype=np.int32), [len(r) for r in runs])
        run, n = np.concatenate(runs), np.concatenate(often)
        # a stretch stands for the numbers of its pre-tokens
        numbers = Numbers()
        lists = [[numbers[p] for p in self.pre_tokens(s)] for s in stretches]
        each = np.array([len(x) for x in lists], dtype=np.int64)
        flat, begins = np.fromiter((n for x in lists for n in x), dtype=np.int32, count=each.sum()), np.cumsum(each) - each
        times = each[run]
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - begins[run], times)
        return list(numbers), flat[at], np.repeat(text, times), np.repeat(n, times), besides


def _counter(path: str) -> PieceCounter:
    place = memo("pieces")
    if getattr(place, "path", None) != path:
        place.counter, place.path = PieceCounter(path), path
    return place.counter


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``.

    ``tokenizer``: path of a byte-level BPE .json. No begin, end or added special tokens, no truncation or padding;
    special strings in a text are handled as the library's default has it. A null text counts as empty (0 bytes, 0
    tokens). Repeated rows and ids stay repeated; a null id stays null; other columns, whatever their names, are not
    read. An empty table gives an empty result. Texts are read once and never shuffled.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text_of(docs, text_col)).cast("long").alias("n_bytes"), text_of(docs, text_col).alias("text"))
    index = postings(source, ["doc_id", "n_bytes"], lambda: _counter(tokenizer).split)
    count = F.col("_sum") + F.col("_besides")
    return sums(index, source.drop("text").schema, lambda: lambda tokens: list(map(_counter(tokenizer).pieces, tokens))).select("doc_id", "n_bytes", count.alias("n_tokens"), (count > limit).alias("over_limit"))
