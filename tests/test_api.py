import io

import pytest

from scriptoria.api import Conflict, Library
from scriptoria.sources.library import PAPER


def rows(spark, *ids, **more):
    names = [c.split(" ")[0] for c in PAPER.split(", ")]
    base = dict.fromkeys(names) | {c: "" for c in ("authors", "year", "journal", "doi", "tags", "notes")} | {"status": "To read", "collection": "Birds", "starred": False}
    made = [base | {"id": i, "title": f"Title {i}", "pmid": f"123456{k}", "lib_pos": k} | more for k, i in enumerate(ids)]
    return spark.createDataFrame([tuple(m[n] for n in [*names, "lib_pos"]) for m in made], PAPER + ", lib_pos long")


def test_library(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    assert lib.create(rows(spark, "a", "b")) == 0
    papers, revision = lib.read()
    assert lib.write(papers, revision) == 1
    with pytest.raises(Conflict):
        lib.write(papers, revision)
    with pytest.raises(ValueError):
        lib.write(papers.unionByName(papers), 1)
    lib.rename_collection("Birds", "Nests")
    lib.delete_collection("Nests")
    assert {r.collection for r in lib.read()[0].collect()} == {"Unfiled"}
    lib.add(rows(spark, "b", "c", pmid=""))
    assert [r.id for r in lib.view().orderBy("rank").collect()] == ["c", "a", "b"]
    m = spark.createDataFrame([(1, "See (1234560).")], "doc_id int, text string")
    assert lib.cite(m).first().text == "See [1]."
    assert lib.cite(m, "author-date").first().text == "See (Title a, n.d.)."
    assert lib.write_word(m).first().content[:2] == b"PK"
    files = spark.createDataFrame([("f", 3)], "file_id string, length long")
    assert lib.deletable(files).count() == 1 and lib.storage(files).first().unused_bytes == 3
    out = io.BytesIO()
    assert lib.backup(spark.createDataFrame([("x.pdf", bytearray(b"x"))], "name string, content binary"), out) == 2
    names = spark.createDataFrame([("Birds",)], "collection string")
    with pytest.raises(Conflict):
        lib.create_collection("birds", names)
    assert lib.create_collection("Reeds", names).count() == 2
    blocks = spark.createDataFrame([("d", 1, 0, "Nests of reed birds"), ("d", 2, 1, "Other matters")], "pdf_id string, page int, ord long, text string")
    assert lib.passages(blocks, "where are reed nests").first().context == "[p. 1] Nests of reed birds"
