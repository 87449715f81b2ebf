"""What Python workers keep from one step to the next."""

import pyarrow as pa
import pytest

from framegauge.llm import packing, simhash, simple8b, toxicity, workers

TEXTS = pa.RecordBatch.from_pydict({"text": ["one two three four five", None, ""]})
PIECES = pa.table(
    {"g": pa.array([0, 0], pa.int32()), "b": pa.array([None, None], pa.int64()), "length": pa.array([3, 4])}
)
STEPS = {
    "stems": lambda: list(toxicity._count_stems(iter([TEXTS]), None)),
    "fingerprints": lambda: list(simhash._fingerprint_batches(iter([TEXTS]), 4)),
    "links": lambda: simhash._cell_links(pa.table({"bits": pa.array([1, 3, 1 << 40])})),
    "groups": lambda: packing._pack_group(PIECES, 8, 0, True, ["g", "b", "o"]),
}


@pytest.mark.parametrize("step", STEPS)
def test_steps_without_a_state_carry_none(step):
    workers.worker_state("words of an earlier step", lambda: {"word": b"ids"})
    STEPS[step]()
    assert workers._state is None
    assert workers.worker_state("words of an earlier step", lambda: "built anew") == "built anew"
    workers.drop_state()


def test_token_files_meet_each_of_many_words_once():
    made = []
    most_bytes = getattr(simple8b, "WORD_BYTES", workers.STORE_BYTES)
    store = workers.Store(lambda word: made.append(word) or b"12345678", most_bytes)
    words = [f" word{k:06d}" for k in range(550_000)]  # about twice what fits half of STORE_BYTES
    for _ in range(2):
        for word in words:
            store[word]
    assert len(made) == len(words)
