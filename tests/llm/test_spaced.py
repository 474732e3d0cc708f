"""Letters parted by any of the four separators count, with or without a full stop in the text."""

from kindling.llm import toxicity


def test_spaced_letters():
    rate = [toxicity.features(t, frozenset())[15] for t in ("you i-d-i-o-t!", "i d i o t", "i_d_i_o_t", "i*d*i*o*t", "i.d.i.o.t", "all well")]
    assert all(x > 0 for x in rate[:5]) and rate[5] == 0


def test_masked_words_by_their_rule():
    """As the pattern with two lookaheads finds them, on short texts; in linear time on long ones."""
    import random
    import re
    import time

    slow, draw = re.compile(r"(?=[\w@$*!]*[0-9@$*!])(?=[\w@$*!]*[a-z])[a-z0-9@$*!]{3,}"), random.Random(3)
    for _ in range(20_000):
        text = "".join(draw.choice("ab1@*_é.- !") for _ in range(draw.randrange(20)))
        assert toxicity.masked(text) == slow.findall(text)
    for text in ("a" * 1_000_000 + " 1", "a1_" * 300_000, "a b " * 250_000 + "1"):
        began = time.process_time()
        toxicity.features(text, frozenset())
        assert time.process_time() - began < 5
