"""Words and parts of words that a guesser would try, read from vocabulary files where they lie: none are kept here."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache

#: Vocabularies that are read unless others are named.
FILES = ("word_bpe_49k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model")
#: Letters that a word has at least and at most.
LEAST, MOST = 4, 24


def installed() -> tuple[str, ...]:
    """The paths of FILES in the installed public_tokenizers package."""
    import public_tokenizers

    return tuple(map(public_tokenizers.path, FILES))


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    own = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def tokens(path: str) -> Iterator[str]:
    """The tokens of a vocabulary by id, without marks of words' beginnings and ends; those that are no UTF-8 are left out.

    .json: byte-level vocabularies of the tokenizers library; .tiktoken: ranks; .model: sentencepiece."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        yield from (model.id_to_piece(i).removeprefix("▁") for i in range(model.get_piece_size()))
        return
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            raw = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    elif path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        letters = _byte_letters()
        spelled = (t.removesuffix("</w>") for t in sorted(vocab, key=vocab.__getitem__))
        raw = [bytes(map(letters.__getitem__, t)) for t in spelled if all(c in letters for c in t)]
    else:
        raise ValueError(f"no vocabulary: {path}")
    for t in raw:
        try:
            yield t.decode().strip()
        except UnicodeDecodeError:
            continue


@lru_cache(maxsize=4)
def common(paths: tuple[str, ...]) -> tuple[str, ...]:
    """Lower-cased words of LEAST to MOST letters, by their best share of a vocabulary's length, the more frequent first (ids
    follow frequency in vocabularies of merges). Files that are repeated change nothing; no files give no words."""
    best: dict[str, float] = {}
    for path in paths:
        found = list(tokens(path))
        for i, t in enumerate(found):
            w = t.lower()
            if LEAST <= len(w) <= MOST and w.isalpha():
                best[w] = min(best.get(w, 1.0), i / len(found))
    return tuple(sorted(best, key=lambda w: (best[w], w)))
