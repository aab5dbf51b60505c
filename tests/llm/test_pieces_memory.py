import pyarrow as pa

from lexweave.llm import pieces


def test_texts_are_encoded_a_bounded_run_at_a_time():
    """What an encoder gets at once, and the words it keeps, are bounded whatever the rows of a batch."""
    texts = pa.array(["x", "a" * 600_000, None, "\u00e4" * 300_000, "b" * 600_000, "c"])
    starts = pieces.text_starts(texts)
    assert starts.tolist() == [0, 1, 600_001, 600_001, 1_200_001, 1_800_001, 1_800_002]
    assert pieces.text_starts(texts.slice(2, 2)).tolist() == [0, 0, 600_000] and pieces.text_starts(texts.slice(0, 0)).tolist() == [0]
    assert max(starts[j] - starts[i] for i, j in pieces.slices(starts, pieces.BYTES_AT_ONCE)) <= 1_000_000
    assert pieces.CACHED_WORDS <= 100_000
