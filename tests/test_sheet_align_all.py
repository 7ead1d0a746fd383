from foliodiff.plans import catalogue


def brute(doc):
    ref = {doc % 3: "Main" if doc % 2 == 0 else f"S{doc % 5}", 3: "Totals"}
    ver = {doc % 4: "Main" if doc % 3 == 0 else f"T{doc % 5}"} | ({4: "Totals"} if doc % 7 < 3 else {})
    free = dict(ver)
    for at, name in sorted(ref.items()):
        at = next((i for i, other in free.items() if other == name), at)
        other = free.pop(at, "")
        yield doc, name, other, "removed" if not other else "same" if other == name else "renamed"


def test_every_customer_is_a_document(spark, tmp_path):
    keys = [1, 2, 6, 201, 206, 401, 1006, 14999]
    spark.createDataFrame([(k,) for k in keys + keys], "o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted(map(tuple, catalogue.queries()["sheet_align"](spark, str(tmp_path)).select("doc", "sheet", "other", "how").collect()))
    assert got == sorted(x for k in keys for x in brute(k))
    assert {k for k, *_ in got} == set(keys)


def test_relations_have_no_modulus_on_documents():
    assert all("% 200" not in catalogue.oracle_sql()[q] for q in ("sheet_align_all", "sheet_align"))
