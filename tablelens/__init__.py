"""tablelens: profiling, KPIs, reports and data-quality checks on Spark.

The main entry points, re-exported for convenience::

    from tablelens import get_session, load_files, profile_table, anomaly_report
"""

from tablelens.operators.anomaly import anomaly_report, detect, severity_summary, type_counts
from tablelens.operators.drift import schema_drift
from tablelens.operators.kpi import kpis
from tablelens.operators.profile import (
    distinct_counts,
    histograms,
    null_rates,
    numeric_summary,
    profile_table,
    table_overview,
)
from tablelens.operators.quantiles import approx_quantiles, exact_quantiles
from tablelens.operators.stats import column_stats
from tablelens.plans.ask import chart_data, log_query, preview, recent_queries, run_sql
from tablelens.plans.reports import (
    customer_segments,
    monthly_trend,
    revenue_by_category,
    revenue_by_category_share,
    top_group_in_period,
    top_groups,
)
from tablelens.session import get_session, local_frame, materialize, ship_package
from tablelens.sources.catalog import (
    catalog_digest,
    ingest,
    list_tables,
    read_lake,
    register,
    safe_table_name,
    save_report,
    write_lake,
)
from tablelens.sources.files import load_files, read_csv, read_table
from tablelens.sources.sqlite import read_sqlite, read_sqlite_tables
from tablelens.sources.workbook import read_sheet, read_workbooks
from tablelens.streaming.monitor import monitor_files

__all__ = [n for n in dir() if not n.startswith("_")]
