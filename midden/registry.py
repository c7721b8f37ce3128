"""Every query of the library by name, and the SQL that it must match."""

from __future__ import annotations

from .plans import ancient, centring, cleanups, communities, evidence, repairs, sequences, slate

assert ancient and centring and cleanups and communities and evidence and repairs and sequences  # they register their queries with the slate

FLAGSHIP = "set_quality"
QUERIES = dict(slate.QUERIES)
ORACLES = dict(slate.ORACLES)
