"""What a job has on disk at a time: shuffle files go with their stage, and large joins run in rounds."""

import random

from crumbtrail.llm import near_duplicates as module
from crumbtrail.llm import variant_names
from crumbtrail.session import stage


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {blocks.apply(k).getName() for k in range(blocks.length()) if "shuffle_" in blocks.apply(k).getName()}


def test_shuffle_files_go_with_their_stage(spark):
    before = shuffle_files(spark)
    summed = spark.range(1000).groupBy("id").count()
    rows = stage(summed, "sums")
    assert not shuffle_files(spark) - before
    assert rows.count() == 1000


def test_rounds_give_the_same_groups(spark, monkeypatch):
    dishes = ["grilled chicken sandwich", "grilled chickn sandwich", "grld chicken sandwich", "lentil soup", "lentl soup", "tomato soup"]
    rows = [(k, b, d) for k, (b, d) in enumerate((b, d) for b in range(12) for d in dishes for _ in range(9 if len(d) > 11 and "n s" in d else 1))]
    df = spark.createDataFrame(rows, "id long, business_id long, name string")

    def groups():
        return sorted(map(tuple, variant_names.name_groups(df, "business_id", "name", "id").collect()))

    whole, joined = groups(), []
    monkeypatch.setattr(variant_names, "ROUND_ITEMS", 10)
    near = variant_names.near_items
    monkeypatch.setattr(variant_names, "near_items", lambda items, floor: joined.append(items.count()) or near(items, floor))
    assert groups() == whole
    assert len(joined) > 3 and max(joined) < sum(joined) / 2


def test_rounds_give_the_same_links(spark, monkeypatch):
    r = random.Random(3)
    texts = [[f"w{r.randrange(300)}" for _ in range(40)] for _ in range(60)]
    texts += [[*t[:20], "other", *t[21:]] for t in texts[:20]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")

    def links():
        return sorted(map(tuple, module.near_duplicates(df, "id", "text")[1].collect()))

    whole, parts = links(), []
    monkeypatch.setattr(module, "ROUND_BUCKETS", 5)
    emit = module._emit
    monkeypatch.setattr(module, "_emit", lambda *args: parts.append(args[-1]) or emit(*args))
    assert links() == whole and len(whole) == 20
    assert parts == [(0, 3), (1, 3), (2, 3)]
