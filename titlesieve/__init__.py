"""Screening of large collections of titled documents on Spark."""

from titlesieve.functions.replies import parse_reply, resolve_attempts
from titlesieve.functions.stopwords import STOP_WORDS
from titlesieve.functions.text import (
    exclude,
    include_all,
    include_any,
    keyword_array,
    length_between,
    parse_keywords,
    parse_year,
    word_count,
)
from titlesieve.operators.batches import ranked_progress, read_verdicts, run_ranked_batches
from titlesieve.operators.columns import (
    drop_blank_titles,
    find_title_column,
    map_columns,
    require_columns,
    to_canonical,
    with_verdict_columns,
)
from titlesieve.operators.dedup import duplicate_report, remove_duplicates
from titlesieve.operators.filters import (
    FilterSpec,
    apply_filter,
    remove_rows,
    removal_report,
    reset_filters,
    search,
    split_by_decision,
)
from titlesieve.operators.ordered import OrderedTable, store_ordered
from titlesieve.operators.paging import page, page_info
from titlesieve.operators.review import (
    accepted_decisions,
    current_item,
    kept_rows,
    replay,
    review_counts,
    review_queue,
)
from titlesieve.operators.stats import (
    confidence_breakdown,
    dataset_stats,
    decision_counts,
    decision_shares,
    filter_stats,
    import_report,
    reviewer_progress,
    skip_reasons,
    workload_estimate,
)
from titlesieve.operators.tables import (
    cascade_delete,
    check_rows,
    check_unique,
    insert_if_absent,
    load_users,
    orphans,
    seed_progress,
    user_load_report,
    validate,
)
from titlesieve.operators.triage import (
    attach_verdicts,
    batch_progress,
    merge_progress,
    remaining,
    render_prompts,
    run_batches,
)
from titlesieve.operators.uniqueness import accept_in_order
from titlesieve.operators.words import with_relative, word_counts, word_frequencies
from titlesieve.sources.readers import describe_source, read_papers, resolve_source
from titlesieve.sources.writers import (
    append_papers,
    current_triage,
    export_nonempty,
    publish_triage,
    write_csv,
    write_triage,
)
from titlesieve.streaming.live import (
    dedup_decisions,
    live_progress,
    read_progress,
    triage_stream,
    write_progress,
)
from titlesieve.streaming.stores import (
    current_progress,
    first_decisions,
    keep_first_decisions,
    upsert_progress,
)

__all__ = [name for name in dir() if not name.startswith("_")]
