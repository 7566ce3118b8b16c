from hypothesis import given, settings, strategies as st

from tamiz.operators.chunk import chunk_text


def windows(text, size, overlap):
    """Chunks by positions in the joined text."""
    words = text.split()
    joined, starts, at = " ".join(words), [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    out = []
    for i in range(0, len(words), max(1, size - overlap)):
        last = min(i + size, len(words)) - 1
        end = starts[last] + len(words[last])
        out.append((len(out), joined[starts[i]:end], starts[i], end))
    return out


def run(spark, text, size, overlap):
    df = spark.createDataFrame([("d", text)], "doc_name string, text string")
    rows = chunk_text(df, chunk_size=size, overlap=overlap).collect()
    return sorted((r["chunk_id"], r["text"], r["char_start"], r["char_end"]) for r in rows)


def test_tail_inside_the_previous_chunk_is_kept(spark):
    got = run(spark, "A B C D E F G H", 5, 2)
    assert [g[1] for g in got] == ["A B C D E", "D E F G H", "G H"]


def test_no_words_no_chunks(spark):
    assert run(spark, "", 5, 2) == [] and run(spark, " \n\t ", 5, 2) == []


@settings(max_examples=20, deadline=None)
@given(
    st.text(alphabet="abñ漢😀 \n\t\x1c  ", max_size=120),
    st.integers(1, 7),
    st.integers(-2, 8),
)
def test_against_positions(spark, text, size, overlap):
    assert run(spark, text, size, overlap) == windows(text, size, overlap)


def test_long_document_is_linear_enough(spark):
    text = " ".join(f"palabra{i}" for i in range(60_000))
    got = run(spark, text, 300, 50)
    assert got == windows(text, 300, 50)
