import numpy as np
from molspark.llm import bpe, common, fingerprint, langid, near_dedup


def test_a_worker_holds_the_memory_of_one_step():
    """The steps of a pipeline share workers; what one remembers must not stay beside the next."""
    model = langid.Model(["en"], [b"a", b"b"], np.array([[0.5, 0.5, 0.0]]))
    common.worker_memory(("langid", 1), lambda: langid._Scorer(model))
    assert list(common._MEMORY) == [("langid", 1)]
    near_dedup.shingle_set(b"one two three four five six")
    (words,) = common._MEMORY.values()
    assert isinstance(words, fingerprint.WordHashes) and len(words) == 6
    near_dedup.shingle_set(b"one two three four five seven")
    assert len(words) == 7
    ranks = {bytes([b]): b for b in range(256)}
    known = bpe._remembered(ranks)
    assert list(common._MEMORY.values()) == [known] and bpe._remembered(dict(ranks)) is known
    assert bpe._remembered(ranks | {b"ab": 256}) is not known and len(common._MEMORY) == 1
    common.forget()
    assert not common._MEMORY
