"""corvane: evaluation of generated text at scale, as Spark plans."""
