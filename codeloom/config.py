"""Constants of the library, in one place."""

from __future__ import annotations

# Paths that look like tests; they count in history but never pair with each other.
TEST_LIKE = (
    "**/tests/**", "**/test/**", "**/__tests__/**", "**/Tests/**", "**/*Test.php", "**/*_test.php", "**/*.test.ts", "**/*.test.tsx",
    "**/*.test.js", "**/*.test.jsx", "**/*.spec.ts", "**/*.spec.tsx", "**/*.spec.js", "**/*.spec.jsx", "**/test_*.py", "**/*_test.py",
    "**/*_test.rs", "**/*_test.go", "**/*.phpt", "**/benches/**", "**/benchmarks/**",
)

# What is left out by default besides tests.
ALWAYS_EXCLUDED = (
    "**/vendor/**", "**/node_modules/**", "**/bower_components/**", "**/jspm_packages/**", "**/.bundle/**",
    "**/dist/**", "**/build/**", "**/out/**", "**/target/**", "**/_build/**", "**/.next/**", "**/.nuxt/**", "**/.svelte-kit/**", "**/.turbo/**",
    "**/.vercel/**", "**/.parcel-cache/**", "**/.angular/**", "**/.gradle/**", "**/cmake-build-*/**", "**/public/js/**", "**/public/build/**",
    "**/storage/framework/views/**",
    "**/__pycache__/**", "**/*.pyc", "**/*.pyo", "**/*.class", "**/*.o", "**/*.obj", "**/*.a", "**/*.lib", "**/*.so", "**/*.dylib", "**/*.dll",
    "**/*.exe", "**/*.egg-info/**",
    "**/coverage/**", "**/.coverage", "**/htmlcov/**", "**/.nyc_output/**", "**/*.lcov",
    "**/.cache/**", "**/.pytest_cache/**", "**/.ruff_cache/**", "**/.mypy_cache/**", "**/.tox/**", "**/.eslintcache",
    "**/*.min.js", "**/*.min.css", "**/*.min.mjs", "**/*.bundle.js", "**/*.chunk.js", "**/*.generated.*", "**/*.gen.ts", "**/*.gen.tsx",
    "**/*.gen.js", "**/*.gen.go", "**/*embeddings*.json",
    "**/package-lock.json", "**/yarn.lock", "**/pnpm-lock.yaml", "**/bun.lockb", "**/composer.lock", "**/Cargo.lock", "**/poetry.lock",
    "**/Pipfile.lock", "**/uv.lock", "**/Gemfile.lock", "**/go.sum", "**/mix.lock",
    "**/docs/**", "**/doc/**", "**/site/**", "**/_site/**", "**/NEWS", "**/NEWS.md", "**/UPGRADING", "**/UPGRADING.md", "**/UPGRADING.INTERNALS",
    "**/CHANGELOG", "**/CHANGELOG.md", "**/CHANGELOG.txt", "**/CHANGES", "**/CHANGES.md", "**/HISTORY", "**/HISTORY.md", "**/RELEASE_NOTES",
    "**/RELEASE_NOTES.md",
    "**/.idea/**", "**/.vscode/**", "**/.vs/**", "**/*.swp", "**/*.swo", "**/.DS_Store",
)
DEFAULT_EXCLUDED = TEST_LIKE + ALWAYS_EXCLUDED

# Languages by file extension; .h is C unless the project has a C++ file.
EXTENSIONS = {
    "php": "php", "py": "python", "pyi": "python", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c++": "cpp", "cppm": "cpp", "ixx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "h++": "cpp", "tpp": "cpp", "ipp": "cpp",
    "rs": "rust", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go",
}

# History.
DECAY_DAYS = 180.0
CHURN_CAP = 3.0
MAX_FILES_PER_COMMIT = 30
MIN_PAIR_COUNT = 3
SKIP_PREFIXES = ("chore:", "chore(", "build:", "build(", "ci:", "style:", "docs:")
RESCUE_WORDS = ("migrate", "refactor", "adopt", "deprecate", "upgrade")
FIX_PREFIXES = ("fix:", "fix(", "bugfix:", "hotfix:")
FIX_PARTS = (" fix ", " fixes ", "fixes #", "fixes gh-", "closes #")

# Risk.
RISK_WEIGHTS = {"churn": 0.35, "fix": 0.20, "dependents": 0.15, "coupling": 0.15, "test_gap": 0.15}
DEPENDENTS_FULL, COUPLED_FULL = 20.0, 10.0
HOTSPOT, FIX_HEAVY, FIX_MIN_COMMITS, WIDE_BLAST, HIGH_COUPLING, HIGH_RISK = 0.75, 0.4, 5, 10, 5, 0.6
CLUSTER_FROM, CLUSTER_SHOWN = 5, 3

# Retrieval.
RRF_K = 60
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6
RARE_SHARE, RARE_MIN_BYTES = 0.01, 8
SYMBOL_BOOST = 0.1
CHUNK_SIZE, CHUNK_MIN, CHUNK_OVERLAP = 1000, 250, 150
BUDGET_CHARS = 8000 * 4
MAX_REASONS = 10

# Vector queries that one scan answers.
QUERY_BLOCK = 2048
