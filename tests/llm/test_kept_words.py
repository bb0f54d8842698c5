"""Words that a task meets again are not coded again, as far as the table goes."""

from lodespark.llm import byte_bpe


def test_words_of_a_task_are_coded_once(monkeypatch):
    coder, coded = byte_bpe.Encoder(*byte_bpe.default_vocabulary()), []
    monkeypatch.setattr(coder, "word", lambda w: coded.append(w) or b"\0\0\0\0")
    letters = str.maketrans("0123456789", "abcdefghij")
    words = [str(k).translate(letters) for k in range(250_000)]  # more than a task of 8000 documents of the check tool codes at once
    for _ in range(2):
        for at in range(0, len(words), 1000):
            coder.encode("x " + " ".join(words[at : at + 1000]))
    assert len(coded) <= len(words) + 1
