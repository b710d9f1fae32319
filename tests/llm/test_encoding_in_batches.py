"""op8's encoder over batches of texts against the library, text by text."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from boxwright.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def awkward_texts():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdeé日 ", k=rng.randint(0, 9)))
    odd = ["", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\n b", "a \nb", "a\nb c", "don't stop", "x.y, z!", "\t a", "a  b", "a  b c", "1 22 3a", "日本 語 x", "\U0001f600 y", "a. b.. c", " \n ", "a\r\nb c", "end."]
    return odd + [" ".join(word() + rng.choice(["", ".", ",", "\n", "'s", "\n\n", "?x"]) for _ in range(rng.randint(0, 80))) for _ in range(300)]


def test_batches_equal_the_library_text_by_text():
    encoder, texts = packing.Encoder(PATH), awkward_texts()
    whole = [np.array(encoder.chain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode_all(texts) == whole
    assert encoder.encode_all(pa.array(["x", *texts, "y"]).slice(1, len(texts))) == whole  # known pieces, a slice
    assert [encoder.encode(t) for t in texts] == whole and encoder.encode_all([]) == []


def test_a_batch_looks_each_piece_up_once(monkeypatch):
    encoder, asked = packing.Encoder(PATH), []
    known = encoder._known
    monkeypatch.setattr(encoder, "_known", lambda pieces: asked.append(len(pieces)) or known(pieces), raising=False)
    encoder.encode_all(["one two three two"] * 500)
    assert asked == [2]
