"""quillgraph: document analytics and evidence-grounded question answering on Spark."""
