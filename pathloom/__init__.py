"""Clustering of web addresses as Spark DataFrame operations."""

from importlib import import_module

_MODULE_OF = {
    "functions.url": ("python_sorter", "split_url"),
    "functions.weights": ("PythonWeight", "zipf_coefficient"),
    "operators.clustering": ("assign_clusters", "cluster_urls", "fit_clusters"),
    "operators.coordinates": ("attach_labels", "plane_coordinates"),
    "operators.features": ("url_features", "weighted_coefficients"),
    "operators.scores": ("evaluate_clusters", "silhouette", "v_measure"),
    "operators.terms": ("explode_terms", "split_urls"),
    "operators.timing": ("profile_fit", "timing_summary"),
    "operators.vocabulary": ("rank_terms", "top_terms", "vocabulary"),
    "operators.word_vectors": ("word_vectors", "word_vectors_by_window"),
    "plans.search": ("Trial", "grid_trials", "random_trials", "search_clusters"),
    "sources.tables": ("UrlStore", "read_labels", "read_urls"),
}
_WHERE = {name: module for module, names in _MODULE_OF.items() for name in names}

__all__ = sorted(_WHERE)


def __getattr__(name: str):
    """Modules are imported at first use: Python workers, which import this package for a function of one module, need few of them."""
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_WHERE[name]}"), name)
