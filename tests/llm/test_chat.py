import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import chat

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
marks = st.lists(st.sampled_from(["\\", "###", "</turn>", ": ", ":", " ", "#", "\n", "a", "é", "😀", "<", "/turn>", "### assistant: "]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(marks, marks), max_size=5))
def test_rendering_is_reversible(turns):
    text, _ = chat.render(turns)
    assert chat.parse(text) == turns


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), marks), max_size=5), st.data())
def test_mask_holds_the_learned_text_alone(turns, data):
    text, spans = chat.render(turns)
    cuts = sorted(data.draw(st.sets(st.integers(0, len(text)), max_size=30)) | {0, len(text)})
    tokens = np.array([(a, b) for a, b in zip(cuts, cuts[1:]) for _ in range(1 + (a % 3 == 0))], np.int64).reshape(-1, 2)
    _, lo, hi = chat.mask(tokens, spans)
    assert chat.unescape(chat.masked_text(text, lo, hi)) == "".join(t for r, t in turns if r == "assistant")


def test_read_back(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", " \n é😀 ### x"), (1, 2, "assistant", None), (2, 0, None, "a"), (2, 0, None, "a"), (3, None, "assistant", "z"), (None, 4, "assistant", "n" * 5000), (3, 0, "system", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as formatted", "1 as ids", "2 as turns")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(df, TOKENIZER)).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((t is not None, t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda k: (k[0], k[1] or 0, k[2:]))
        turns = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.formatted(df.limit(0), TOKENIZER)).count() == 0
