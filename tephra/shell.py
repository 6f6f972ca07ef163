"""A console over one stored log.

    python -m tephra.shell file:///data/kv

Reads go by one of three ways: exact; skipping, which leaves levels out by the arithmetic
rule and can miss keys; learned, through a learned filter for each level, which is exact.
"""

from __future__ import annotations

import cmd
import shlex
import statistics
import sys
import time
from collections import defaultdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tephra.functions import values
from tephra.operators import reads
from tephra.operators.learned import LevelFilters
from tephra.sources.store import KeyValueStore

WAYS = ("exact", "skipping", "learned")


class Console(cmd.Cmd):
    prompt = "tephra> "

    def __init__(self, store: KeyValueStore, **streams):
        super().__init__(**streams)
        self.store, self.way, self.took = store, "exact", defaultdict(list)
        self.filters: tuple[int, LevelFilters] | None = None

    def say(self, text: str) -> None:
        print(text, file=self.stdout)

    def onecmd(self, line: str) -> bool:
        name, began = line.split(" ", 1)[0], time.perf_counter()
        try:
            over = super().onecmd(line)
        except (TypeError, ValueError) as e:
            self.say(f"{name}: {e}")
            return False
        self.took[name].append(time.perf_counter() - began)
        return bool(over)

    def emptyline(self) -> bool:
        return False

    def _found(self, key: float):
        if self.way == "exact" or self.store._canonical(key) in self.store.buffer:
            return self.store.get(key)
        keys = self.store.spark.createDataFrame([(key,)], "key double")
        log = self.store.log(key, key)
        if self.way == "skipping":
            kept = (F.col("level") < 1) | ~values.skip_level(F.col("key"), F.col("level"))
            return reads.get_with(log, keys, kept).first()["value"]
        if not self.filters or self.filters[0] != self.store.version:
            self.filters = self.store.version, LevelFilters().train(self.store.stored())
        return self.filters[1].get(log, keys).first()["value"]

    def do_put(self, line: str) -> None:
        """put KEY VALUE"""
        key, value = shlex.split(line)
        self.store.put(float(key), value)

    def do_get(self, line: str) -> None:
        """get KEY"""
        value = self._found(float(line))
        self.say("absent" if value is None else value)

    def do_range(self, line: str) -> None:
        """range LOW HIGH: live keys, both ends included"""
        low, high = map(float, line.split())
        for r in self.store.range(low, high).toLocalIterator():
            self.say(f"{r['key']:g}\t{r['value']}")

    def do_remove(self, line: str) -> None:
        """remove KEY"""
        self.store.remove(float(line))

    def do_flush(self, _: str) -> None:
        """flush: writes the buffer as a run"""
        self.say("flushed" if self.store.flush() else "nothing to flush")

    def do_compact(self, line: str) -> None:
        """compact LEVEL: merges it into the next"""
        self.store.compact(int(line))

    def do_switch(self, line: str) -> None:
        """switch exact|skipping|learned: how get reads"""
        if line not in WAYS:
            raise ValueError(f"one of {', '.join(WAYS)}")
        self.way = line

    def do_stats(self, _: str) -> None:
        """stats: buffer, levels, and how long commands took"""
        self.say(f"{self.way} reads; {len(self.store.buffer)} writes in the buffer")
        for r in self.store.level_stats().orderBy(F.col("level").asc_nulls_last()).collect():
            self.say(f"{'total' if r['level'] is None else 'level ' + str(r['level'])}: {r['n_runs']} runs, {r['n_entries'] or 0} entries")
        for name, seconds in self.took.items():
            self.say(f"{name}: {len(seconds)} times, ms: mean {1e3 * statistics.mean(seconds):.1f}, least {1e3 * min(seconds):.1f}, most {1e3 * max(seconds):.1f}")

    def do_reset(self, _: str) -> None:
        """reset: empties the table and the times"""
        self.store.clear()
        self.took.clear()
        self.filters = None

    def do_exit(self, _: str) -> bool:
        """exit"""
        self.store.flush()
        return True

    do_EOF = do_exit


if __name__ == "__main__":
    Console(KeyValueStore(SparkSession.builder.getOrCreate(), sys.argv[1])).cmdloop()
