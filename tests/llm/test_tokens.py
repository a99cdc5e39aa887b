"""Parts of texts that are encoded apart give the ids of whole texts, and a word is encoded once whatever punctuation follows it."""

import json

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers, trainers

import brute
from wxspark.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = [
    *["a", "Bc", "ab", "the", "7", "42", " ", " ", " ", "  ", "\n", "\n\n", "\r\n", "\t", "\x0b", "\x1c", "\x7f", "\x85", "\xa0", "\u1680", "\u180e", "\u2000"],
    *["\u2003", "\u200b", "\u2028", "\u202f", "\u205f", "\u3000", "\ufeff", ".", ",", "...", "***", "'", "'s", "'ll", "-", "_", "<", "|", ">", "<|endoftext|>", "<|x"],
    *["\u00e9", "\u00c9", "\u00df", "\u00f1.", "\u00d7", "\u00f7", "\u00aa", "\u0133", "\u01c6", "\u024f", "\u0416", "\u044f", "\u03a9", "\u0301", "\u2026", "\u201c"],
    *["\u2014", "\u65e5\u672c", "\u304b", "\u1780", "\U0001d4b3", "\U0001f642"],
]


def mixtures(seed: int, n: int) -> list[str]:
    rnd = np.random.default_rng(seed)
    return ["".join(rnd.choice(BITS, rnd.integers(0, 30))) for _ in range(n)]


def vocabulary(kind: str, folder) -> str:
    if kind == "public":
        return PATH
    path = str(folder / f"{kind}.json")
    if kind == "added":
        # Cuts at punctuation would fall into all but the first.
        made = Tokenizer.from_file(PATH)
        made.add_tokens(["<ab>", "ab.", "\u00e9,", "the-42", "7|", "\u65e5\u672c."])
    else:
        # Merges of white space, of punctuation and across all that the pre-tokenizer leaves together.
        made = Tokenizer(models.BPE())
        made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
        trainer = trainers.BpeTrainer(vocab_size=3000, initial_alphabet=sorted(pre_tokenizers.ByteLevel.alphabet()), special_tokens=["<|endoftext|>"], show_progress=False)
        made.train_from_iterator(mixtures(1, 2000), trainer)
    made.save(path)
    if kind == "added":
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        for t in spec["added_tokens"]:
            t["normalized"] = False
        with open(path, "w", encoding="utf-8") as f:
            json.dump(spec, f)
    return path


@pytest.mark.parametrize("kind", ["public", "added", "trained"])
def test_parts_give_the_ids_of_whole_texts(kind, tmp_path):
    path = vocabulary(kind, tmp_path)
    e = tokens.Encoder(path)
    assert e.by_parts
    for seed, most in ((2, 300_000), (3, 300_000), (4, 5), (5, 0)):
        e.most_parts = max(most, len(e.known))
        texts = mixtures(seed, 2500)
        ids, n = e.encode(pa.array(["skipped", *texts, "skipped"]).slice(1, len(texts)))
        assert [a.tolist() for a in np.split(ids, np.cumsum(n)[:-1])] == brute.tokens(texts, path)
    small = tokens.Encoder(path)
    for most in (7, 7, 40):
        small.most_parts = most
        ids, n = small.encode(pa.array(texts))
        assert len(small.known) == len(small.count) == most
        assert [a.tolist() for a in np.split(ids, np.cumsum(n)[:-1])] == brute.tokens(texts, path)


@pytest.mark.parametrize("texts", [[], [""], ["", "", ""], [" "], ["\n", "", " a"], ["a", " ", "\u3000"], ["é.", ".", "é"]])
def test_hardly_any_text(texts):
    ids, n = tokens.Encoder(PATH).encode(pa.array(texts, pa.string()))
    assert len(n) == len(texts) and n.sum() == len(ids)
    assert [a.tolist() for a in np.split(ids, np.cumsum(n))][: len(texts)] == (brute.tokens(texts, PATH) if texts else [])


def test_a_word_is_encoded_once_whatever_punctuation_follows():
    rnd = np.random.default_rng(6)
    words = ["".join(rnd.choice(list("abcdefghé"), 9)) for _ in range(400)]
    lines = [" ".join([w + end for w in rnd.permutation(words)]) for end in ("", ".", ",", "!", "?)", "***", "&&&") for _ in range(2)]
    e, given = tokens.Encoder(PATH), []
    e.whole = lambda parts: (given.append(sum(map(len, parts))), tokens.Encoder.whole(e, parts))[1]
    ids, n = e.encode(pa.array(lines))
    assert [a.tolist() for a in np.split(ids, np.cumsum(n)[:-1])] == brute.tokens(lines, PATH)
    # Each word after a space once, and the first word and the endings of the lines.
    assert sum(given) <= sum(len(w) + 1 for w in words) + sum(9 + 3 for _ in lines)


def test_lines_share_the_words_at_their_ends():
    rnd = np.random.default_rng(7)
    words = ["".join(rnd.choice(list("abcdefgh"), 9)) for _ in range(60)]
    text = "\n".join(f"{rnd.choice(words)} {rnd.choice(words)}." for _ in range(3000))
    e, given = tokens.Encoder(PATH), []
    e.whole = lambda parts: (given.append(sum(map(len, parts))), tokens.Encoder.whole(e, parts))[1]
    ids, _ = e.encode(pa.array([text]))
    assert ids.tolist() == brute.tokens([text], PATH)[0]
    assert sum(given) <= 2 * sum(len(w) + 1 for w in words) + 20
