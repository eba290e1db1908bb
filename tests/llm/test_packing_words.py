"""The encoder of packing by distinct words: equal to the tokenizer, each word encoded once."""

import random
import re

import numpy as np
import pyarrow as pa

from gatewarden.llm import packing


def ids(raw):
    return np.frombuffer(raw, np.uint16).tolist()


class Counted:
    """The tokenizer with what is asked of it noted."""

    def __init__(self, tok):
        self.tok, self.model, self.words, self.texts = tok, self, [], []

    def tokenize(self, word):
        self.words.append(word)
        return self.tok.model.tokenize(word)

    def encode(self, text, **more):
        self.texts.append(text)
        return self.tok.encode(text, **more)


def test_each_word_is_encoded_once_whatever_stands_beside_it():
    own = packing.WordEncoder(packing.tokenizer_path())
    own.tok = seen = Counted(own.tok)
    words = [f"{a}{b}{c}" for a in ("gla", "ströd", "mip") for b in ("nor", "tul", "vek") for c in ("dan", "fis", "lom")]
    texts = [" ".join(f"{before}{w.upper()}{after}" for w in words) for before in ("", "(", '"') for after in ("", ",", ".", "!", "?)")]
    found = own.encode(pa.array([*texts, *reversed(texts)], pa.string()))
    again = own.encode(pa.array(texts, pa.string()))
    assert [ids(x) for x in found[: len(texts)]] == [seen.tok.encode(t, add_special_tokens=False).ids for t in texts] and again == found[: len(texts)] == found[: len(texts) - 1 : -1]
    assert not seen.texts and len(seen.words) == len(set(seen.words)) and sum(len(w) > 3 for w in seen.words) == len(words)


def test_ids_equal_the_tokenizers_as_generations_of_words_go(monkeypatch):
    monkeypatch.setattr(packing.WordEncoder, "MOST", 40)
    own = packing.WordEncoder(packing.tokenizer_path())
    plain = [chr(k) for k in range(0x250) if re.fullmatch(f"[{own.PLAIN}]", chr(k))]
    rng, others = random.Random(5), ["\x85", "\xa0", "\x1c", "²", "日", "é", "<|endoftext|>", "<|ENDOFTEXT|>"]
    marks = [" ", " ", "'", "'s", "'LL", "'re", "_", "7", "\n", "\x0b"]
    texts = ["", " \t ", "a" * 5000, *(f"{a}{c}{b}" for c in plain for a, b in (("", ""), ("x", "y"), ("9", "'")))]
    texts += ["".join(rng.choices(plain + marks * 20, k=rng.randrange(60))) for _ in range(1500)]
    texts += ["".join(rng.choices(plain + others * 4 + marks * 20, k=rng.randrange(60))) for _ in range(500)]
    rng.shuffle(texts)
    want = [own.tok.encode(t, add_special_tokens=False).ids for t in texts]
    for size in (1, 7, 3000):
        assert [ids(x) for k in range(0, len(texts), size) for x in own.encode(pa.array(texts, pa.string()).slice(k, size))] == want
    assert own.encode(pa.array([None, "a", None], pa.large_string())) == [b"", own("a"), b""] and own.encode(pa.array([], pa.string())) == []
    assert 0 < len(own.older) <= 40 and len(own.newer) <= 40
