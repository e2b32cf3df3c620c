import contextlib
import io


def explained(df) -> str:
    """The physical plan as text; of a finished adaptive plan, the final part only."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue().split("== Initial Plan ==")[0]
