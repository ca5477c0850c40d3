"""Token counts by rank-synchronous array merging.

A byte-level BPE vocabulary is read once on the driver (its size is fixed by the file) and sent to the tasks as sorted arrays.
In a task, the distinct pre-tokens of a group of texts become one ragged array: flat symbol ids and a sequence number for each.
Every round finds, for all sequences at once, the lowest-rank adjacent pair of each sequence and applies it at all its places;
a merged symbol only takes part in later ranks, so this equals merging one pair at a time. The symbols that survive are counted.

Cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows each give a row; an empty table gives an empty result;
columns besides the id and the text are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenaflow.llm.common import chunks, text_or_empty

#: How the byte-level vocabulary files split text; White_Space is what \s means to the library.
PRETOKENS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
SHIFT = np.uint64(32)
#: Pre-tokens whose counts a Python worker remembers between groups of texts; beyond it the memory is emptied.
REMEMBERED = 400_000


@dataclass
class Merges:
    """Pairs as sorted ``left << 32 | right`` with their ranks and results; byte_ids maps a byte to its symbol."""

    keys: np.ndarray
    ranks: np.ndarray
    results: np.ndarray
    byte_ids: np.ndarray
    special: list[str]


def byte_letters() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def load_merges(path: str) -> Merges:
    """Reads a byte-level BPE ``.json``; raises ValueError for options that this counter doesn't implement."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"]
    plain = (
        model["type"] == "BPE" and pre["type"] == "ByteLevel" and pre.get("use_regex", True)
        and not pre["add_prefix_space"] and not spec["normalizer"] and not model.get("ignore_merges")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
    )
    if not plain:
        raise ValueError(f"{path} asks for options besides plain byte-level BPE")
    ids = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left = np.array([ids[a] for a, _ in pairs], np.uint64)
    right = np.array([ids[b] for _, b in pairs], np.uint64)
    keys = (left << SHIFT) | right
    order = np.argsort(keys)
    results = np.array([ids[a + b] for a, b in pairs], np.uint64)
    return Merges(
        keys[order], order.astype(np.int64), results[order],
        np.array([ids[c] for c in byte_letters()], np.uint64), [t["content"] for t in spec["added_tokens"]],
    )


def merged_lengths(tokens: list[str], m: Merges) -> np.ndarray:
    """How many symbols are left of each pre-token after all merges."""
    raw = [t.encode() for t in tokens]
    sizes = np.array([len(r) for r in raw])
    out = sizes.copy()
    sym = m.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    seq = np.repeat(np.arange(len(raw)), sizes)
    none = np.iinfo(np.int64).max
    while len(sym) > 1:
        keys = (sym[:-1] << SHIFT) | sym[1:]
        at = np.minimum(np.searchsorted(m.keys, keys), len(m.keys) - 1)
        rank = np.where((m.keys[at] == keys) & (seq[:-1] == seq[1:]), m.ranks[at], none)
        first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        low = np.minimum.reduceat(np.r_[rank, none], first)
        best = np.repeat(low, np.diff(np.r_[first, len(seq)]))
        hit = np.flatnonzero((rank == best[:-1]) & (rank != none))
        if not len(hit):
            break
        # of overlapping places of one pair (as in "aaa") the 1st, 3rd, ... count
        run = np.flatnonzero(np.r_[True, np.diff(hit) != 1])
        nth = np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))
        hit = hit[nth % 2 == 0]
        np.subtract.at(out, seq[hit], 1)
        sym[hit] = m.results[at[hit]]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        keep &= np.repeat(low != none, np.diff(np.r_[first, len(seq)]))  # finished sequences leave
        sym, seq = sym[keep], seq[keep]
    return out


def token_counter(merges: Merges) -> "Column":
    split = regex.compile(PRETOKENS)
    cut = regex.compile("|".join(map(regex.escape, merges.special))) if merges.special else None
    shared: dict[str, int] = {}

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), np.int64)
        values = texts.tolist()
        for lo, hi in chunks(values):
            found = []
            for i in range(lo, hi):
                parts = [values[i]]
                if cut is not None and cut.search(values[i]):
                    parts = cut.split(values[i])
                    out[i] = len(parts) - 1
                found.append([t for p in parts for t in split.findall(p)] if len(parts) > 1 else split.findall(parts[0]))
            if len(shared) > REMEMBERED:
                shared.clear()
            new = list({t for f in found for t in f if t not in shared})
            if new:
                shared.update(zip(new, merged_lengths(new, merges).tolist()))
            for i, f in enumerate(found, lo):
                out[i] += sum(map(shared.__getitem__, f))
        return pd.Series(out)

    return count


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row; ``vocabulary`` is the path of a byte-level BPE file on the driver."""
    count = token_counter(load_merges(vocabulary))
    text = text_or_empty(text_col)
    return (
        docs.select(F.col(id_col), text.alias("text"))
        .select(id_col, F.octet_length("text").cast("long").alias("n_bytes"), count("text").alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
