"""An evidence-analytics engine on Spark: corpora, chunks, rankings, citations, evaluation and facts as DataFrame plans."""

from gleaner.session import prepare

__all__ = ["prepare"]
__version__ = "0.1.0"
