"""Windows of the toxicity network hold every short passage whole."""

from ratertrail.llm import toxicity


def test_passages_of_half_a_window_are_whole_in_one():
    half = toxicity.WINDOW // 2
    for n in (20, 40, 41, 60, 72, 73, 200, 1001):
        starts = toxicity.windows_of(n)
        assert all(any(s <= at and at + half <= s + toxicity.WINDOW for s in starts) for at in range(n - half + 1))
