"""Summarise a Spark event log (as written with BENCH_EVENT_LOG_DIR): stage seconds per job description.

Usage: python tools/stage_times.py <event-log-dir>
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
from collections import defaultdict


def events(path: str):
    for f in sorted(glob.glob(os.path.join(path, "**", "events_*"), recursive=True)):
        with open(f, "rb") as fh:
            if f.endswith(".zstd"):
                import zstandard
                stream = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
            else:
                stream = io.TextIOWrapper(fh, encoding="utf-8")
            for line in stream:
                try:
                    yield json.loads(line)
                except ValueError:
                    continue


def main() -> None:
    stage_desc, per_desc, count = {}, defaultdict(float), defaultdict(int)
    for e in events(sys.argv[1]):
        if e.get("Event") == "SparkListenerJobStart":
            desc = (e.get("Properties") or {}).get("spark.job.description", "(none)")
            for sid in e.get("Stage IDs", []):
                stage_desc[sid] = desc
        elif e.get("Event") == "SparkListenerStageCompleted":
            info = e["Stage Info"]
            dur = (info.get("Completion Time", 0) - info.get("Submission Time", 0)) / 1000
            d = stage_desc.get(info["Stage ID"], "(none)")
            per_desc[d] += dur
            count[d] += 1
    for d, sec in sorted(per_desc.items(), key=lambda kv: -kv[1]):
        print(f"{sec:8.2f}s  {count[d]:4d} stages  {d}")


if __name__ == "__main__":
    main()
