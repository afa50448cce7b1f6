"""strataloom: mining of software repositories and text corpora as Spark plans."""
