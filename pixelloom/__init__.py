"""pixelloom: image, vector and page-document analytics expressed as Spark plans."""
