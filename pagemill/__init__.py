"""Page extraction and crawl analytics over tables of captured web pages."""
