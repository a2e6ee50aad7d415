"""Fixed values that must equal the scanned application's behaviour.

Everything in this module is data, not logic: vocabularies, file-name lists,
patterns and weights that a scan result depends on.  Operators turn these
lists into literal Spark expressions (rule arrays) or small broadcast
dimension tables; nothing here grows with the data.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# FIXED VALUES: browsers and the feature -> baseline status mapping
# --------------------------------------------------------------------------
BROWSERS = ["chrome", "firefox", "safari", "edge"]

FEATURE_STATUS = {
    "fetch": "supported",
    "navigator.clipboard": "partial",
    "dynamic-import": "supported",
    "async-await": "supported",
    "css-has-pseudo": "partial",
    "XMLHttpRequest": "partial",
    "core-js/features/promise": "unknown",
    "Intl": "supported",
    "css-backdrop-filter": "partial",
    "css-grid": "supported",
    "css-flexbox": "supported",
    "css-variables": "supported",
    "IntersectionObserver": "supported",
    "ResizeObserver": "partial",
    "WebAnimations": "supported",
    "WebComponents": "partial",
    "ShadowDOM": "partial",
    "CustomElements": "supported",
    "PointerEvents": "supported",
    "ServiceWorker": "supported",
    "WebWorker": "supported",
    "WebSockets": "supported",
    "WebGL": "supported",
    "WebRTC": "partial",
    "WebAudio": "supported",
    "WebVR": "unknown",
    "WebXR": "partial",
    "WebUSB": "partial",
    "WebBluetooth": "partial",
    "WebNFC": "unknown",
    "WebShare": "partial",
    "PaymentRequest": "partial",
    "CredentialManagement": "partial",
    "WebAuthn": "partial",
    "core-js/features/array/flat": "supported",
    "core-js/features/array/flat-map": "supported",
    "core-js/features/object/from-entries": "supported",
    "core-js/features/string/match-all": "supported",
    "core-js/features/string/replace-all": "supported",
    "AbortController": "supported",
    "FileSystemAccess": "partial",
    "Notification": "partial",
    "PushManager": "partial",
    "IndexedDB": "supported",
    "localStorage": "supported",
    "sessionStorage": "supported",
    "BroadcastChannel": "supported",
    "crypto.subtle": "supported",
    "clipboard-read": "partial",
    "clipboard-write": "partial",
}

# Feature keys -> compat-data paths (fallback lookup, JOIN-02).
COMPAT_ALIASES = {
    "async-await": "javascript.operators.await",
    "optional-chaining": "javascript.operators.optional_chaining",
    "nullish-coalescing": "javascript.operators.nullish_coalescing",
    "dynamic-import": "javascript.statements.import.dynamic_import",
    "class-fields": "javascript.classes.class_fields.public_class_fields",
    "private-class-fields": "javascript.classes.class_fields.private_class_fields",
    "promise-allSettled": "javascript.builtins.Promise.allSettled",
    "string-replaceAll": "javascript.builtins.String.replaceAll",
    "top-level-await": "javascript.operators.await.top_level_await",
    "XMLHttpRequest": "api.XMLHttpRequest",
    "Worker": "api.Worker",
    "SharedWorker": "api.SharedWorker",
    "IntersectionObserver": "api.IntersectionObserver",
    "ResizeObserver": "api.ResizeObserver",
    "AbortController": "api.AbortController",
    "ServiceWorker": "api.ServiceWorker",
    "WebSockets": "api.WebSocket",
    "WebRTC": "api.RTCPeerConnection",
    "WebGL": "api.WebGLRenderingContext",
    "WebAudio": "api.AudioContext",
    "IndexedDB": "api.IDBDatabase",
    "navigator.clipboard": "api.Clipboard",
    "WebShare": "api.Navigator.share",
    "CustomElements": "api.CustomElementRegistry",
    "css-variables": "css.properties.--*",
    "css-backdrop-filter": "css.properties.backdrop-filter",
    "css-grid": "css.features.grid",
    "css-flexbox": "css.features.flexbox",
    "css-clamp": "css.types.clamp",
    "css-has-pseudo": "css.selectors.has",
    "css-subgrid": "css.features.subgrid",
    "css-container-queries": "css.at-rules.container",
    "css-nesting": "css.selectors.nesting",
}

# Status words and their rank for worst-case reduction over browsers.
# unsupported 3 > partial 2 > supported 1 > unknown 0.
STATUS_RANK_WORDS = {
    3: ["unsupported", "no", "n"],
    2: ["partial", "a"],
    1: ["supported", "yes", "y"],
}
STATUS_BY_RANK = {3: "unsupported", 2: "partial", 1: "supported", 0: "unknown"}

# Impact rank per status (unknown counts as 1, like supported).
IMPACT_RANK = {"unsupported": 3, "partial": 2}
IMPACT_RANK_DEFAULT = 1

# --------------------------------------------------------------------------
# FIXED VALUES: JS / CSS feature detection
# --------------------------------------------------------------------------
JS_EXTS = [".js", ".jsx", ".ts", ".tsx"]
CSS_EXTS = [".css", ".scss"]

# --------------------------------------------------------------------------
# FIXED VALUES: config files and build tools
# --------------------------------------------------------------------------
CONFIG_FILE_NAMES = [
    ".browserslistrc", "browserslist", "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "angular.json", "nx.json", "workspace.json", "lerna.json",
    "tsconfig.json", "tsconfig.app.json", "tsconfig.spec.json",
    "vite.config.js", "vite.config.ts",
    "webpack.config.js", "rollup.config.js", "esbuild.config.js",
    "babel.config.js", "postcss.config.js", "tailwind.config.js",
    "jest.config.js", "karma.conf.js", "protractor.conf.js",
    "eslint.config.js", ".eslintrc.js", ".eslintrc.json",
    "prettier.config.js", ".prettierrc", ".prettierrc.json",
    "next.config.js", "next.config.mjs", "nuxt.config.js", "nuxt.config.ts",
    "svelte.config.js", "vue.config.js", "docker-compose.yml", "Dockerfile",
]

# (config file, build tool)
BUILD_TOOL_RULES = [
    ("vite.config.js", "Vite"), ("vite.config.ts", "Vite"),
    ("webpack.config.js", "Webpack"),
    ("rollup.config.js", "Rollup"),
    ("esbuild.config.js", "esbuild"),
    ("babel.config.js", "Babel"),
    ("postcss.config.js", "PostCSS"),
    ("tailwind.config.js", "Tailwind CSS"),
    ("tsconfig.json", "TypeScript"), ("tsconfig.app.json", "TypeScript"),
]

# (config file, framework) fallback heuristics
CONFIG_FRAMEWORK_RULES = [
    ("angular.json", "Angular"), ("tsconfig.app.json", "Angular"), ("tsconfig.spec.json", "Angular"),
    ("nx.json", "Nx"), ("workspace.json", "Nx"),
    ("next.config.js", "Next.js"), ("next.config.mjs", "Next.js"),
    ("nuxt.config.js", "Nuxt"), ("nuxt.config.ts", "Nuxt"),
    ("vue.config.js", "Vue"),
    ("svelte.config.js", "Svelte"),
]

# --------------------------------------------------------------------------
# FIXED VALUES: technology evaluation (name, approved, status, testing level)
# --------------------------------------------------------------------------
TECH_EVALUATION = [
    ("Next.js", True, "active", "smoke"),
    ("SvelteKit", True, "active", "smoke"),
    ("Nuxt", True, "active", "smoke"),
    ("Vue", True, "active", "smoke"),
    ("Nx", True, "active", "smoke"),
    ("Angular", True, "active", "targeted"),
    ("Python", True, "active", "targeted"),
    ("Java", True, "active", "targeted"),
    ("Go", True, "active", "targeted"),
    ("ML", True, "active", "thorough"),
]
