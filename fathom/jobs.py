"""Lists of crawls to run: NAME=value lines, a line ---jobs---, then tab-separated start, output and shown root."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Job:
    start: str
    output: str
    shown: str | None = None


@dataclass
class JobList:
    settings: dict[str, str] = field(default_factory=dict)
    jobs: list[Job] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)


def read_jobs(text: str, known: frozenset[str] | None = None) -> JobList:
    """Blank lines and comments do not count; settings that are malformed or not known are ignored; a job
    without a tab is an error."""
    out, in_jobs = JobList(), False
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line == "---jobs---":
            in_jobs = True
        elif in_jobs:
            if "\t" not in line:
                raise ValueError(f"job lines must be tab-separated: {line}")
            start, output, *rest = (x.strip() for x in line.split("\t"))
            out.jobs.append(Job(start, output, rest[0] if rest and rest[0] else None))
        elif (m := re.fullmatch(r"([A-Za-z_]\w*)=(.*)", line)) and (known is None or m[1] in known):
            out.settings[m[1]] = m[2].strip()
        else:
            out.ignored.append(line)
    return out
