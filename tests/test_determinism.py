"""Same seed, same answer across processes (different Python hash seeds)."""
import os
import subprocess
import sys

SCRIPT = r'''
import hashlib, sys
sys.path.insert(0, sys.argv[1])
from bnlake.session import get_spark
from bnlake.plans.model import FittedNetwork
from bnlake.spec import NetworkSpec, Node

def u(*parts):
    h = hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    return int(h[:13], 16) / 2 ** 52

spark = get_spark(master="local[2]", partitions=3, app="bnlake-determinism")
spec = NetworkSpec([Node("a", "a"), Node("b", "b", ("a",)), Node("y", "y", ("a", "b"))], target="y",
                   tracks={"all": ["a", "b"]}, key="id", order_col="id")
rows = [(i, f"v{int(u('a', i) * 4)}", int(u('b', i) * 3), int(u('y', i) * 2)) for i in range(300)]
df = spark.createDataFrame(rows, "id long, a string, b int, y int")
m = FittedNetwork.fit(df, spec)
cpt = sorted(tuple(r) for r in m.cpt.collect())
smp = sorted(tuple(r) for r in m.sample(500, seed=9).collect())
print("DIGEST", hashlib.sha1(repr((cpt, smp)).encode()).hexdigest())
'''


def _run(hash_seed: str) -> str:
    env = dict(os.environ, PYTHONHASHSEED=hash_seed)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", SCRIPT, root], env=env, capture_output=True,
                         text=True, timeout=600)
    lines = [x for x in out.stdout.splitlines() if x.startswith("DIGEST")]
    assert lines, out.stderr[-2000:]
    return lines[0]


def test_same_answer_across_processes():
    assert _run("1") == _run("12345")
