"""What edit classes write on the way."""

import random

from brisa.llm import editwalk
from brisa.llm.batches import stage
from made import documents
from pyspark.sql import functions as F


def test_edit_buckets_are_narrow(spark, monkeypatch):
    kept = {}

    def spy(df, name, *args):
        kept.setdefault(name, stage(df, name, *args))
        return kept[name] if name == "edit-prints" else stage(df, name, *args)

    monkeypatch.setattr(editwalk, "stage", spy)
    rng = random.Random(8)
    text = " ".join(str(rng.random()) for _ in range(60))
    out = editwalk.with_classes(documents(spark, [(1, text, "en", "a"), (2, text[:-2] + "!", "en", "a"), (3, "else", "en", "a")]))
    assert {r.doc_id: r.class_id for r in out.collect()} == {1: 1, 2: 1, 3: 3}
    assert "fingerprint" not in kept["edit-texts"].columns  # hashes of the bands only
    assert dict(kept["edit-buckets"].dtypes)["key"] == "bigint"
    assert kept["edit-buckets"].agg(F.max(F.octet_length("id"))).first()[0] == editwalk.ID_BYTES
