"""heronlake: text retrieval, crawl analytics and ranking evaluation on Spark DataFrames."""
