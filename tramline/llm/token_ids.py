"""Token ids of the public byte-level BPE vocabulary, as numpy arrays.

The vocabulary files come as two forms of the same table; the ranks are used here because they are
encoded several times faster, and the tests hold the ids against the other form. The other form also
has a mark for the end of a text, with an id of its own; the text is split at it. One encoder lives in
each worker process.
"""

import base64
import re
from functools import lru_cache
from pathlib import Path

import numpy as np

VOCABULARY = "byte_bpe_50k.tiktoken"
MARK = "<|endoftext|>"
VOCABULARY_JSON = "byte_bpe_50k.json"
# The fast encoder's pattern takes a run of white space at one go and overflows its stack at half a million
# characters or more; texts with runs from this length on are encoded with the other form.
LONG_RUN = 100_000
_LONG_RUN = re.compile(r"\s{%d}" % LONG_RUN)


@lru_cache(maxsize=2)
def _encoder(path):
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ends = np.zeros(max(ranks.values()) + 2, dtype=bool)
    ends[-1] = True  # the mark, whose id follows the others
    for token, number in ranks.items():
        ends[number] = token.rstrip(b" \"')")[-1:] in (b".", b"!", b"?", b"\n")
    return encoder, ends


@lru_cache(maxsize=2)
def _slow_encoder(path):
    import public_tokenizers
    import tokenizers

    name = public_tokenizers.path(VOCABULARY_JSON) if path is None else Path(path).with_suffix(".json")
    encoder = tokenizers.Tokenizer.from_file(str(name))
    encoder.encode_special_tokens = True  # marks are ordinary text here too
    return encoder


def encode(text, path=None):
    """Ids of a text; the marks of special tokens are ordinary text."""
    text = text or ""
    if len(text) >= LONG_RUN and _LONG_RUN.search(text):
        return np.array(_slow_encoder(path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    return np.array(_encoder(path)[0].encode_ordinary(text), dtype=np.uint32)


def encode_marked(text, path=None):
    """Ids of a text in which the mark for the end of a text has its own id."""
    parts = (text or "").split(MARK)
    if len(parts) == 1:
        return encode(text, path)
    mark = np.array([len(sentence_ends(path)) - 1], dtype=np.uint32)
    return np.concatenate([ids for part in parts for ids in (mark, encode(part, path))][1:])


def sentence_ends(path=None):
    """By id: whether a sentence or a line can end with this token."""
    return _encoder(path)[1]
