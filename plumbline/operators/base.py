"""What an axis gives back."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class AxisResult:
    """findings (in findings_frame()'s columns), candidates (kind, candidate as JSON), excluded (path, reason) and what was scanned."""

    axis: str
    findings: DataFrame
    candidates: DataFrame | None
    excluded: DataFrame
    scanned: DataFrame
    stats: dict = field(default_factory=dict)

    def collect(self) -> dict:
        """The result as plain data: the actions run here."""
        rows = [x.asDict(True) for x in self.findings.orderBy("sort").collect()]
        found = []
        for x in rows:
            places = [{k: v for k, v in p.items() if v is not None} for p in x["locations"]]
            f = {"axis": x["axis"], "severity": x["severity"], "code": x["code"], "message": x["message"], "locations": places}
            if x["payload"] is not None:
                f["payload"] = json.loads(x["payload"])
            found.append(f)
        candidates = [json.loads(x.candidate) for x in self.candidates.collect()] if self.candidates is not None else None
        stats = {k: (v() if callable(v) else v) for k, v in self.stats.items()}
        out = {"axis": self.axis, "findings": found, "stats": {"files_scanned": self.scanned.count(), "excluded": [x.asDict() for x in self.excluded.collect()], "skipped": False} | stats}
        if candidates is not None:
            out["candidates"] = candidates
        return out
