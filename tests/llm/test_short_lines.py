import corpus_pipeline
from tracelake.llm import lines


def _brute(rows):
    """What is left of each text when the later of lines with a Jaccard similarity of 0.8 or more go; lines without words stay."""
    seen, out = [], {}
    for i, text in rows:
        kept = []
        for line in text.split("\n"):
            s = {w for w in "".join(c.lower() if c.isalnum() else " " for c in line).split()}
            if not any(s and 5 * len(s & t) >= 4 * len(s | t) for t in seen):
                kept.append(line)
            seen.append(s)
        out[i] = "\n".join(kept)
    return out


def test_stage_removes_repeats_of_short_lines(spark):
    rows = [
        (1, "Les.\nshort line\n\none two three four"), (2, "les\nline short\nshort\none two three four five\n..."), (3, "Les. Les!\nshort line here\n\n...\none two three"),
        (4, "short\nfour three two one\nshort other\none two three four five six"), (5, "one two three\nhere line short"),
    ]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    want = _brute(rows)
    assert got == {i: (t, len(t)) for i, t in want.items()}
    assert got[2][0] == "short\n..."
    # A bound can be asked for.
    assert {r.doc_id: r.text for r in lines.dedup_lines(docs, min_words=3).collect()}[2].startswith("les\nline short\nshort")
