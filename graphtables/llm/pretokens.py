"""Exact splitting of whole texts into pre-tokens whose byte-level BPE pieces are independent of each other.

The byte-level pre-tokenizer never joins characters across a blank that stands between two non-blank characters: such a
blank always begins the next piece. So a text may be cut before each such blank, and every part encoded on its own, once
per distinct part. The special string of the vocabulary is cut out first, as the library does by default."""

from __future__ import annotations

import base64
import functools
import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import cached, tokenizer_path

SPECIAL = "<|endoftext|>"
#: Marks the first part of a text, which has no blank before it.
FIRST = "\x00"
_BLANKS = r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts that can't simply be split at each blank.
_HARD = rf"[{_BLANKS}] | [{_BLANKS}]|<\|endoftext\|>|\x00"
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters on whose classes all Unicode versions agree.
_PLAIN = re.compile(r"[\t-\r\x20-\x7e\xc0-\xff]*")
#: Pre-tokens that can be encoded one after another as a single text: a blank, then such characters without any.
_ROW = re.compile(r" [\x21-\x7e\xc0-\xff]+")


def _parts(text: str) -> list[str]:
    out: list[str] = []
    for i, segment in enumerate(text.split(SPECIAL)):
        if i:
            out.append(SPECIAL)
        first, *rest = _CUT.split(segment)
        if first:
            out.append(first)
        out.extend(" " + x for x in rest)
    return out


def split_batch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of each part of each text, in order: the text's row, the number of its pre-token; and the distinct pre-tokens."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    hard = pc.match_substring_regex(texts, _HARD)
    first, none = pa.scalar(FIRST, pa.large_string()), pa.scalar("", pa.large_string())
    easy = pc.binary_join_element_wise(first, pc.if_else(hard, none, texts), none)
    lists = pc.split_pattern(easy, " ")
    encoded = lists.flatten().dictionary_encode()
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(np.asarray(lists.offsets)))
    numbers = np.asarray(encoded.indices, dtype=np.int32)
    keys = [x[1:] if x[:1] == FIRST else " " + x for x in encoded.dictionary.to_numpy(zero_copy_only=False).tolist()]
    which = np.flatnonzero(np.asarray(hard))
    if len(which):
        seen: dict[str, int] = {}
        more_rows, more = [], []
        for r in which.tolist():
            parts = _parts(texts[r].as_py())
            more_rows.append(np.full(len(parts), r, np.int32))
            more.append(np.fromiter((seen.setdefault(p, len(seen)) for p in parts), np.int32, len(parts)) + len(keys))
        rows = np.concatenate([rows, *more_rows])
        numbers = np.concatenate([numbers, *more]).astype(np.int32)
        keys.extend(seen)
        order = np.argsort(rows, kind="stable")
        rows, numbers = rows[order], numbers[order]
    return rows, numbers, keys


@functools.lru_cache(maxsize=2)
def _fast(path: str):
    """The encoder made from the library's vocabulary file, and the bytes of each id."""
    import public_tokenizers
    import tiktoken

    plain = tokenizer_path(path.replace(".json", ".tiktoken"))
    with open(plain, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    size[list(ranks.values())] = list(map(len, ranks))
    return tiktoken.Encoding("pretokens", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), size


@functools.lru_cache(maxsize=2)
def codec(path: str):
    """Encoder of single pre-tokens to arrays of ids, made once per Python worker from the library's vocabulary file; the library's own
    tokenizer only where a pre-token needs it."""
    fast, whole = _fast(path)[0], []

    def encode(part: str) -> list[int]:
        if part == SPECIAL or not _PLAIN.fullmatch(part):
            if not whole:
                from tokenizers import Tokenizer

                whole.append(Tokenizer.from_file(tokenizer_path(path)))
            return whole[0].encode(part, add_special_tokens=False).ids
        return fast.encode_ordinary(part)

    return encode


def encode_parts(parts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pre-tokens, one after another, and how many each has.

    Those that are a blank and a plain word are encoded as one text, as the blank always begins a piece: each ends where an id's bytes
    begin with the next blank."""
    fast, size = _fast(path)
    in_row = np.array(list(map(_ROW.fullmatch, parts)), object).astype(bool)
    counts = np.zeros(len(parts), np.int64)
    encode = codec(path)
    others = [encode(parts[i]) for i in np.flatnonzero(~in_row).tolist()]
    counts[~in_row] = list(map(len, others))
    text = "".join(itertools.compress(parts, in_row.tolist()))
    ids = np.array(fast.encode_ordinary(text), np.uint32)
    starts = np.cumsum(size[ids]) - size[ids]
    begins = np.flatnonzero(np.frombuffer(text.encode(), np.uint8)[starts] == ord(" "))
    counts[in_row] = np.diff(np.append(begins, len(ids)))
    flat = np.empty(int(counts.sum()), np.uint32)
    of_row = np.repeat(in_row, counts)
    flat[of_row] = ids
    flat[~of_row] = [y for x in others for y in x]
    return flat, counts


def _clear() -> None:
    codec.cache_clear()
    _fast.cache_clear()


cached(__name__, _clear)
