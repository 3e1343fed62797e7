"""New words reach the tokenizers library together; ids are those of whole texts."""

import random

from valuelab.llm.queries import tokenizer_file
from valuelab.llm.tokens import WordEncoder


class Counting:
    """The library's tokenizer, counting the texts it is given in batches."""

    def __init__(self, inner):
        self.inner, self.texts = inner, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.inner.encode_batch_fast(texts, **options)

    def __getattr__(self, name):
        return getattr(self.inner, name)


def test_new_words_go_to_the_library_together():
    encoder = WordEncoder(tokenizer_file("word_bpe_49k.json"))
    encoder.tokenizer = Counting(encoder.tokenizer)
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdeü.", k=9)) for _ in range(100)) for _ in range(50)]
    assert all(a.tolist() == encoder.encode(t) for a, t in zip(encoder.encode_all(texts), texts))
    assert encoder.tokenizer.texts < 100  # 5,000 words
    encoder.tokenizer.texts = 0
    encoder.encode_all(texts)
    assert encoder.tokenizer.texts == 0


def test_marks_and_wide_characters_stay_apart():
    encoder = WordEncoder(tokenizer_file("word_bpe_49k.json"))
    rng = random.Random(7)
    letters = "aAéüßÜ~ \t\n.,'s!#1Σσς́ñ漢🙂ª\xad\x85\xa0'tl"
    texts = ["".join(rng.choices(letters, k=rng.randrange(50))) for _ in range(1500)] + ["", "~", "~~ ~ a~b ~"]
    assert [a.tolist() for a in encoder.encode_all(texts)] == [encoder.encode(t) for t in texts]
    few = WordEncoder(tokenizer_file("word_bpe_49k.json"), most=10)
    assert [a.tolist() for a in few.encode_all(texts)] == [encoder.encode(t) for t in texts]
    few.mark = [1, 2]  # a tokenizer that has no such word
    assert [a.tolist() for a in few.encode_all(texts[:200])] == [encoder.encode(t) for t in texts[:200]]
