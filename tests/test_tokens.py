import json
import random

import pytest

from paperloom.operators import chunking

public_tokenizers = pytest.importorskip("public_tokenizers")


def plain(text, path, size, overlap):
    """The tokenizer's own ids and texts."""
    tokenizer = chunking._tokenizer(path)
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    return [c for i in range(0, max(1, len(ids) - overlap), size - overlap) if (c := tokenizer.decode(ids[i : i + size]))]


def texts():
    rng = random.Random(5)
    letters = "abc xyz ABC 0123 .,!?'s're \n\t\r\x00\x1c\x85\xa0äßéñ漢字한글ελ🙂👩‍👩‍👧́‮﻿�"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(300)]
    return [*made, "", " ", "🙂" * 50, "a<|endoftext|>b" * 9, "<|endoftext|>", "x" * 5000, "1" * 999, "the" + " the" * 2999]


@pytest.mark.parametrize("size,overlap", [(7, 2), (1, 0), (1000, 200)])
def test_token_runs_are_the_tokenizers(size, overlap):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for t in texts():
        assert chunking.token_split(t, path, size, overlap) == plain(t, path, size, overlap), t


def test_token_runs_of_texts_leave_the_slow_tokenizer_alone(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    expected = plain("the" + " the" * 2999, path, 1000, 200)
    monkeypatch.setattr(chunking, "_tokenizer", lambda p: pytest.fail("not needed"))
    assert chunking.token_split("the" + " the" * 2999, path) == expected
    monkeypatch.undo()
    # Blanks that are too many for the pattern go to the tokenizer.
    assert "".join(chunking.token_split(" " * 2_000_000, path, 100_000, 0)) == " " * 2_000_000


def test_other_tokenizers_are_left_to_themselves(tmp_path):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        spec = json.load(file)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}):
        path = tmp_path / f"{next(iter(change))}.json"
        path.write_text(json.dumps(spec | change), encoding="utf-8")
        assert chunking._ranked(str(path)) is None
        assert chunking.token_split("One Two", str(path), 1, 0) == plain("One Two", str(path), 1, 0)
