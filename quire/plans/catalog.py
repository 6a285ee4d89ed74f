"""Every query over the driver's tables with its SQL counterpart."""

from __future__ import annotations

from quire.plans import images, layout, shapes, values

QUERIES: dict = layout.QUERIES | values.QUERIES | shapes.QUERIES | images.QUERIES
ORACLES: dict[str, str] = layout.ORACLES | values.ORACLES | shapes.ORACLES | images.ORACLES
