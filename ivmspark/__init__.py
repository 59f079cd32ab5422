"""ivmspark: incremental view maintenance on Spark, as a library of plans over versioned tables.

    from ivmspark import source, agg
    plan = source("shop.orders").alias("o").join(source("shop.items").alias("i"), on="item")
    plan.mutate(amount="o.qty * i.price").aggregate(by="region", total=agg.sum("amount")).merge_into(spark, "shop.totals")

Each call is one maintenance step: it reads what changed in the sources since the output's last commit and
commits the output's change, with how far it has read, at once.
"""

from .functions import acc, agg
from .operators.zset import RESERVED, WEIGHT, Delta, as_zset, consolidate, diff, rewind
from .plans.builder import BuildError, Builder, changelog_source, materialize, materialize_append, source
from .plans.run import AppendConflict, RunContext, RunResult, apply_changes, apply_zset, current, drop_log, heartbeat, run, run_append
from .sources.change import ChangelogLayout, ChangelogSource, TableSource, changes_at_tag, delta_of, pin_table, read_as_of, table_changes
from .sources.log import CommitConflict
from .sources.store import Pin, VersionedTable, read_tag, read_watermarks, run_meta, table, tagged_versions

__all__ = [
    "RESERVED", "WEIGHT", "AppendConflict", "BuildError", "Builder", "ChangelogLayout", "ChangelogSource", "CommitConflict", "Delta", "Pin",
    "RunContext", "RunResult", "TableSource", "VersionedTable", "acc", "agg", "apply_changes", "apply_zset", "as_zset",
    "changelog_source", "changes_at_tag", "consolidate", "current", "delta_of", "diff", "drop_log", "heartbeat", "materialize",
    "materialize_append", "pin_table", "read_as_of", "read_tag", "read_watermarks", "rewind", "run", "run_append", "run_meta", "source", "table",
    "table_changes", "tagged_versions",
]
