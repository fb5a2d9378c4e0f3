"""Named queries. Importing this package registers them all."""

from patchweave.plans import analysis, basics, catalog, reports, sweep

__all__ = ["analysis", "basics", "catalog", "reports", "sweep"]
