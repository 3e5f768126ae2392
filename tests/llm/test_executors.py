"""Workers run what the driver sends them; they need no copy of the package."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {root!r})
from faultline.session import local_session
from faultline.llm import collocations, merkle, packing, perplexity, quality, sharding, tiers
import public_tokenizers

spark = local_session(2, shuffle_partitions=2)
path = str(public_tokenizers.path("word_bpe_49k.json"))
docs = spark.createDataFrame(
    [(i, "it is a long way to the end of the line %d and back again\\nso it is" % i, "en", "s%d" % (i % 3), 50)
     for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")


def missing(rows):
    for _ in rows:
        try:
            import faultline
        except ImportError:
            yield 1

assert spark.range(4).rdd.mapPartitions(missing).count() == 4
assert perplexity.quality_rules(docs).count() == 60
assert perplexity.quality_rules(docs, shipped_ngrams=0).count() == 60
assert quality.quality(docs, labels).count() == 60
assert collocations.collocations(docs, 10).count() > 0
assert merkle.manifest(docs, levels=1).where("verified").count() == 60
assert packing.pack(docs, path).count() == 60
assert tiers.pack_tiers(docs, path).count() >= 60
assert sharding.shard(docs, 3).count() == 60
"""


def test_workers_without_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=root)], cwd=tmp_path, env=env, timeout=900,
                          capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-3000:]
