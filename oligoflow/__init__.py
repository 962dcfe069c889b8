"""oligoflow: DNA data-storage channel analytics and corpus preparation on PySpark."""
