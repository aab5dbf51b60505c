import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from lexweave.session import local_session
from lexweave.config import ChunkConfig
from lexweave.operators import chunk, embed, evaluate, search, tokens
spark = local_session(2)
df = spark.createDataFrame([(1, "a b c d"), (2, "a b")], "i long, t string")
cut = chunk.chunk_recursive(df, "t", ChunkConfig(3, 0)).withColumn("id", chunk.strip("content"))
vectors = embed.hash_embed(cut, "content", 8).select("id", "embedding")
asked = embed.hash_embed(df, "t", 8).select("i", "embedding")
assert search.nearest(asked, vectors, 1, query_id="i", item_id="id", metric="cosine").count() == 2
coded = tokens.tokenize(df, "t", tokens.WordTokenizer({{"a": 5}}), keep=["i"]).orderBy("i").collect()
assert coded[1]["input_ids"] == [5, 1]
said = evaluate.generate(df, evaluate.make_generator("echo"), "t").collect()
assert [r["response"] for r in said] == ["a b c d", "a b"]
print("all shipped")
"""


def test_executors_do_not_need_the_package(tmp_path):
    """Run from elsewhere, so that workers cannot import it."""
    root = str(Path(__file__).parent.parent)
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert "all shipped" in done.stdout, done.stderr[-2000:]
