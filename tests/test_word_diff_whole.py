import re

from foliodiff.plans import catalogue


def brute(a, b):
    x, y = (re.findall(r"[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+", s) for s in (a, b))
    out = []
    for i in range(max(len(x), len(y))):
        u, v = (s[i] if i < len(s) else None for s in (x, y))
        out += ["=" + u] if u == v else [m + s for m, s in (("-", u), ("+", v)) if s is not None]
    return "\n".join(s.replace("\\", "\\\\").replace("\n", "\\n") for s in out)


def test_differences_after_200_characters(spark, tmp_path):
    same = " ".join(f"word{i}" for i in range(60))
    texts = [same + " old end", same + "  new\n\nend and\\more", same, "", "", "short"]
    rows = [(i, x, "en" if i < 6 else "de") for i, x in enumerate([*texts, "other language"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r["diff"] for r in catalogue.queries()["word_diff_whole"](spark, str(tmp_path)).collect()}
    assert got == {i: brute(texts[i], texts[i + 1]) for i in range(5)}
    assert "-old\n+new" in got[0] and "…" not in got[0]
