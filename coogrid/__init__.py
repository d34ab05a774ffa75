"""Sparse Boolean and semiring matrix algebra as Spark DataFrame plans."""

from .functions.semiring import SEMIRINGS, Semiring, semiring
from .matrix import Matrix
from .operators.add import axpby_matrix, ewise_add
from .operators.build import (
    bad_entries,
    dedup,
    dedup_values,
    duplicate_entries,
    mirror,
    poisson5pt,
    validate_entries,
)
from .operators.convert import (
    dense_cells,
    from_adjacency,
    from_csr,
    from_dense,
    from_dense_flat,
    to_adjacency,
    to_csr_offsets,
    to_dense,
)
from .operators.intervals import asof, section_memory, sections
from .operators.measure import throughput, timing_stats, trimmed_mean, usage_peak
from .operators.multiply import kronecker, mxm, mxm_add, square_entries, square_workload
from .operators.order import flag_repeats, merge_sorted, merge_values, ordered_positions, sort_by_key
from .operators.reduce import reduce_by_key, reduce_by_runs, scan_by_key
from .operators.solve import Solution, bicgstab, cg
from .operators.spmv import block_cells, spmm, spmv, to_blocks
from .operators.stats import (
    compact_rows,
    ewise_row_nnz,
    matrix_stats,
    mxm_row_nnz,
    mxm_workload,
    result_shape,
    row_nnz,
    workload_histogram,
)
from .operators.vector import (
    axpby,
    axpy,
    diagonal,
    dot,
    ewise,
    full,
    nrm1,
    nrm2,
    scale,
    vsum,
    vsumabs,
    vsumsq,
)
from .plans.ordered import ranked, scan
from .sources.mtx import (
    read_mtx,
    read_mtx_raw,
    read_mtx_square,
    read_mtx_values,
    write_mtx,
    write_mtx_values,
)
from .sources.samples import read_mem_samples, read_time_points, read_usage_samples
from .sources.summary import append_summary, append_summary_text, read_summaries, read_summary_text, section_report
from .sources.workload import load_workload, read_workload, workload_entry

__all__ = [n for n in dir() if not n.startswith("_")]
