"""Reading files as rows and writing results back."""
